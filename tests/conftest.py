import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabulary.session import build_session

    return build_session("local[4]", partitions=4)


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Folders of the test tables: without rows, with rows of nulls only, and with extra columns whose names clash."""
    import glob
    import os

    from pyspark.sql import functions as F

    folders = {kind: tmp_path_factory.mktemp(kind) for kind in ("empty", "nulls", "clash")}
    for path in glob.glob(f"{DATA}/*.parquet"):
        name, df = os.path.basename(path), spark.read.parquet(path)
        if not name.startswith(("p", "doc", "heldout", "mix", "given")) or name == "part.parquet":
            continue
        df.limit(0).write.parquet(str(folders["empty"] / name))
        df.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).write.parquet(str(folders["nulls"] / name))
        extra = [c for c in ("value", "field", "key", "form", "tokens", "id", "row_id", "position", "score_", "region_", "leaf", "s1", "bucket", "h", "start") if c not in df.columns]
        df.withColumns({c: F.lit("x") for c in extra}).write.parquet(str(folders["clash"] / name))
    return folders
