import random

import pytest

WORDS = [a + b + c for a in ("ta", "re", "mo", "li", "su", "ke") for b in ("n", "r", "s", "l") for c in ("a", "o", "ei", "um")]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Write rows as a table and read it: operators take table scans."""
    folder = tmp_path_factory.mktemp("tables")
    made = []

    def build(rows, schema):
        path = str(folder / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return build
