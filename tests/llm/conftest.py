import pytest

from newsflow.session import ship_package


@pytest.fixture(scope="session")
def llm_spark(spark):
    ship_package(spark)
    return spark
