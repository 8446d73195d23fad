"""Declared types of the tables that stages read and write."""

HEADLINE_TRUTH = "input string, output boolean"
PREDICTION = "model string, input string, output boolean"

SOURCE_CATALOG = (
    "name string, type string, url string, rss string, filename string, include array<string>, "
    "exclude array<string>, scroll double, initial_sleep double, minlength double, function_name string"
)
FEED_ENTRY = (
    "ord long, source string, title string, title_detail string, url string, published string, "
    "summary string, description string"
)
PAGE = "page_id long, source string, url string, html string"
LINK = "page_id long, ord int, title string, url string, src string"
URL_HISTORY = (
    "initial_url string, final_url string, title string, source string, isAI boolean, created_at timestamp"
)
ARTICLE = (
    "final_url string, url string, source string, title string, published timestamp, rss_summary string, "
    "isAI boolean, status string, html_path string, last_updated timestamp, text_path string, "
    "content_length long, summary string, short_summary string, description string, rating double, "
    "cluster_label string, topics string, domain string, site_name string, reputation double, date timestamp"
)
SITE = "domain_name string, site_name string, reputation double"
NEWSLETTER = "session_id string, date timestamp, final_newsletter string"
STEP_STATE = "session_id string, step_name string, state_data string, updated_at timestamp"
LOG = (
    "id long, timestamp timestamp, level string, logger_name string, message string, module string, "
    "function_name string, line_number int, step_name string, agent_session string"
)
BATTLE = "round int, winner long, loser long"
STORY = (
    "cat string, section_title string, id long, headline string, rating double, prune boolean, links string"
)
SECTION = (
    "cat string, section_title string, headlines array<struct<id:long,rating:double,headline:string,"
    "prune:boolean,links:array<struct<url:string,site_name:string>>>>"
)
EDIT = "ord int, id long, action string, reason string, rewritten_headline string, target_category string"
VECTOR = "id long, embedding array<float>"
