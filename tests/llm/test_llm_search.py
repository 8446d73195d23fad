"""op3, op6 and op9 against brute force, known pages and hand-made cases."""

import json
import math
import re

import numpy as np
import pytest

from newsflow.llm import chat_queries, vector_queries
from newsflow.llm.collisions import BASES, Block, bases, nearest_by_collisions
from newsflow.llm.queries import load_queries
from newsflow.llm.tool_calls import levels, linked_calls, schema_error
from newsflow.llm.tree_text import main_text, page_texts


def test_neighbours_recall(llm_spark):
    folder = "/root/testdata/sf0.01"
    rows = vector_queries.collision_neighbours(llm_spark, folder).toPandas()
    table = llm_spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        own = rows[rows.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [score[np.flatnonzero(ids == v)[0]] for v in own.vec_id]) and (np.diff(own.score) <= 0).all()
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, -score))[:20]]))
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("name", ["plain", "copies", "clustered", "shifted", "heavy", "flat"])
def test_recall_in_one_block(name):
    """Recall of at least 0.9 on differently shaped vectors; where lengths are equal or nearly so, less than a sixth of a block is verified."""
    draw = np.random.default_rng(5)
    n = 12_000
    x = draw.standard_normal((n, {"flat": 2, "heavy": 8}.get(name, 48)))
    if name == "plain":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif name == "copies":
        x[::3] = x[0]
    elif name == "clustered":
        x = x / 2 + 2 * draw.standard_normal((40, 48))[draw.integers(0, 40, n)]
    elif name == "shifted":
        x += 1
    elif name == "heavy":
        x *= draw.pareto(1.5, n)[:, None] + 1
    block, at = Block(0, np.arange(n), x, bases(x.shape[1] + 1, BASES)), np.arange(0, n, 149)
    hit = 0
    for i, (ids, score) in zip(at, block.nearest(x[at], at, 20)):
        exact = (x * x[i]).sum(axis=1)
        assert len(ids) == 20 and i not in ids and (score == exact[ids]).all()
        hit += (score >= np.sort(np.delete(exact, i))[-20]).sum()
    assert hit / len(at) / 20 >= 0.9
    if name in ("plain", "clustered"):
        assert np.mean([len(found) for found in block.candidates(x[at])]) < n / 6


def test_vectors_beyond_all_squares():
    x = np.array([[1e200, 0.0], [0.0, 1e-200], [1.0, 1.0]])
    found = [ids.tolist() for ids, _ in Block(0, np.arange(3), x, bases(3, BASES)).nearest(x, np.arange(3), 1)]
    assert found == [[2], [2], [0]]


def test_neighbours_odd_rows(llm_spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0]),
            (None, [9.0, 9.0]), (20, [-1.0, 1.0]), (20, [-1.0, 1.0])]
    frame = llm_spark.createDataFrame([(i, v, 0.1, 3) for i, v in rows], "vec_id long, v array<double>, score double, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_by_collisions(frame, "vec_id", "v", 20, 3).collect())
    assert got == sorted([(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0)] + 2 * [(20, 1, 20, 2.0), (20, 2, 0, -1.0), (20, 3, 1, -2.0)])
    assert nearest_by_collisions(frame.limit(0), "vec_id", "v", 20, 3).count() == 0


def test_article_of_given_pages(llm_spark):
    import html
    pages = llm_spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in page_texts(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert found[row["page_id"]]["text"] == want and found[row["page_id"]]["n_chars"] == len(want)


BODY = "This is the body, it goes on, and on, for long enough to count as text. " * 3


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<", "<"), ("only words", "only words"),
    (f"<div class='sidebar'><p>{'menu, item, ' * 30}</p></div><div id='content'><h1>T</h1><p>{BODY}</p><div class='comments'><p>{BODY}</p></div><p>End.</p></div>", f"T\n\n{BODY.strip()}\n\nEnd."),
    (f"<header><p>{BODY}</p></header><main><section><p>{BODY}</p></section><section><p>{BODY}</p></section></main><footer><p>{BODY}</p></footer>", f"{BODY.strip()}\n\n{BODY.strip()}"),
    (f"<body><form><p>{BODY}</p></form><article><p title='a > b'>{BODY}<script>if (a<b) '</p>'</script></p><ul><li>x &lt; y</ul></article><div role=complementary><p>{BODY}</p></div>", f"{BODY.strip()}\n\nx < y"),
    (f"<article><p>one\n two&nbsp;three <b>four<p>{BODY}<!-- <p>no</p> --></article><div class=cookie-notice><p>{BODY}</p></div>", f"one two three four\n\n{BODY.strip()}"),
    (f"<div><div class='post'><p>{BODY}</p></div><div class='related'><p><a href=x>{BODY}</a></p></div><div hidden><p>{BODY}</p></div></div>", BODY.strip()),
])
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<div class='layout has-sidebar'><h1>T</h1><p>{BODY}</p></div>", f"T\n\n{BODY.strip()}"),
    (f"<div class='content no-sidebar'><article><p>{BODY}</p></article></div>", BODY.strip()),
    (f"<article><p>{BODY}</p><h2 id='social-impact'>One</h2><p>{BODY}</p><h2 class='section-header'>Two</h2><p>{BODY}</p></article>", f"{BODY.strip()}\n\nOne\n\n{BODY.strip()}\n\nTwo\n\n{BODY.strip()}"),
    (f"<div class='widget'><p>{BODY}</p></div><p>x</p>", BODY.strip()),
    (f"<div class='sidebar'><main><p>{BODY}</p></main></div><div class='sidebar'><p>{BODY}</p></div>", BODY.strip()),
    (f"<div role='form'><p>{BODY}</p></div>", BODY.strip()),
    (f"<article><p>{BODY}</p></article><div class='cookie-notice'><p>{BODY * 4}</p></div>", BODY.strip()),
    (f"<article><p>{BODY}</p><div class='related-posts'><article><p>{BODY}</p></article></div></article>", BODY.strip()),
])
def test_names_of_wrappers_and_headings(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<article><header><h1>T</h1></header><div><p>{BODY}</p></div></article>", f"T\n\n{BODY.strip()}"),
    (f"<article><div><p>{BODY * 9}</p></div><h3>H</h3><section><p>Short section.</p></section><p>See <a href=x>this</a></p><ul><li>one<li>two</ul><blockquote>So be it</blockquote>"
     f"<table><tr><td>1<td>2</table></article><div><p>no</p></div>", f"{(BODY * 9).strip()}\n\nH\n\nShort section.\n\nSee this\n\none\n\ntwo\n\nSo be it\n\n1\n\n2"),
    (f"<main><h2>T</h2><p>Lead</p><article><div><p>{BODY}</p></div><p>End</p></article></main><p>no</p>", f"T\n\nLead\n\n{BODY.strip()}\n\nEnd"),
    (f"<main><article><div><p>{BODY}</p></div><p>End</p></article><article><p>no</p></article></main>", f"{BODY.strip()}\n\nEnd"),
])
def test_all_parts_of_an_article(page, want):
    assert main_text(page) == want


def test_deep_and_long_pages_end():
    main_text(f"<div class='{'nav_' * 5000}!'>x</div>")
    assert main_text("<div>" * 30_000 + "x") == "x"
    assert main_text("<p>a, b" * 20_000).count("a, b") == 20_000


def test_page_rows(llm_spark):
    frame = llm_spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, map(tuple, page_texts(frame).collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "a", 1), (1, None, "", 0)]))
    assert page_texts(frame.limit(0)).count() == 0


def test_linking_equals_sql(llm_spark, small):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    rows = [tuple(r) for r in chat_queries.tool_call_linking(llm_spark, small).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, db.execute(load_queries()[1]["op9_tool_call_linking"]).fetchall()))
    assert rows


def test_levels_of_chains_and_cycles(llm_spark):
    rows = [("a", []), ("b", ["a"]), ("c", ["b", "a", "zz"]), ("d", ["e"]), ("e", ["d"]), ("f", ["d"]), ("a", None), (None, ["a"]), ("g", ["g"])]
    got = {r["call_id"]: r["level"] for r in levels(llm_spark.createDataFrame(rows, "call_id string, needs array<string>")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": None}


def test_linking_odd_rows(llm_spark):
    calls = llm_spark.createDataFrame(
        [(1, 2, "x", "t", '{"b":1,"a":[true,null]}', ["y"], 0), (1, 3, "y", "t", "{", None, 0), (1, 4, None, "t", "{}", None, 0), (2, 1, "x", "no", "{}", [], 0), (None, None, "z", None, None, None, 0)],
        "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, level int")
    results = llm_spark.createDataFrame([(1, 9, "x", "late"), (1, 5, "x", "é\n"), (1, 6, "q", None), (3, 1, None, "lost")], "conv_id long, turn long, call_id string, content string")
    rows = linked_calls(calls, results, {"t": {"type": "object", "required": ["a"]}}).collect()
    got = {(r["conv_id"], r["turn"], r["call_id"]): r for r in rows}
    assert len(rows) == 7
    first = got[1, 2, "x"]
    assert first["valid"] and first["level"] == 1 and first["linked"] and first["n_results"] == 2
    assert first["json"] == '{"arguments":{"a":[true,null],"b":1},"id":"x","name":"t","result":"é\\n"}'
    assert got[1, 3, "y"]["error"] == "arguments are not JSON" and got[2, 1, "x"]["error"] == "unknown tool" and not got[2, 1, "x"]["linked"]
    assert got[1, 4, None]["error"] == "$.a: missing" and not got[1, 4, None]["linked"]
    assert got[1, 6, "q"]["error"] == got[3, 1, None]["error"] == "result without a call"
    assert all(json.loads(r["json"]) is not None for r in rows)
    assert linked_calls(calls.limit(0), results.limit(0), {}).count() == 0


@pytest.mark.parametrize("value, schema, error", [
    (True, {"type": "integer"}, "$: not integer"), (1, {"type": ["string", "number"]}, None), (1.5, {"maximum": 1}, "$: too large"), ("ab", {"maxLength": 1}, "$: too long"),
    ({"a": 1}, {"properties": {}, "additionalProperties": False}, "$.a: unknown"), ([1, "x"], {"items": {"type": "integer"}}, "$[1]: not integer"), (None, {"type": "null"}, None),
    ("x", {"enum": ["y"]}, "$: not one of the values"), (True, {"type": "boolean"}, None)])
def test_schema_errors(value, schema, error):
    assert schema_error(value, schema) == error


def test_arguments_that_are_hardly_json(llm_spark):
    texts = ['{"text":"\\ud800"}', '{"text":1e999}', "[" * 100_000, "1" * 5000, '{"a":NaN}', '{"a":1}', '{"a":"\\ud83d\\ude00"}']
    calls = llm_spark.createDataFrame([(1, i, f"c{i}", "t", x, None) for i, x in enumerate(texts)], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = llm_spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = {r["turn"]: (r["valid"], r["error"], json.loads(r["json"])["arguments"]) for r in linked_calls(calls, results, {"t": {}}).collect()}
    bad = "arguments are not JSON"
    assert [got[i][:2] for i in range(7)] == [(False, bad)] * 5 + [(True, None)] * 2
    assert [got[i][2] for i in range(7)] == texts[:5] + [{"a": 1}, {"a": "\U0001f600"}]
    assert schema_error(1, {"type": "decimal"}) == "$: the schema's type decimal is not known"


def test_ids_belong_to_their_conversation(llm_spark):
    calls = llm_spark.createDataFrame(
        [(1, 0, "x", "t", "1", []), (2, 0, "x", "t", "2", ["y"]), (2, 1, "y", "t", "3", []), (None, 0, "x", "t", "4", ["y"])],
        "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = llm_spark.createDataFrame([(1, 5, "x", "one"), (2, 1, "x", "two"), (3, 1, "x", "three"), (None, 2, "x", "none")], "conv_id long, turn long, call_id string, content string")
    got = sorted((str(r["conv_id"]), r["call_id"], r["level"], r["linked"], r["n_results"], json.loads(r["json"])["result"]) for r in linked_calls(calls, results, {"t": {}}).collect())
    assert got == [("1", "x", 0, True, 1, "one"), ("2", "x", 1, True, 1, "two"), ("2", "y", 0, False, 0, None), ("3", "x", None, False, 1, "three"), ("None", "x", 0, True, 1, "none")]
