"""Streams over tables as they may lie: a file, a folder of one file or of several, a file without rows."""

import shutil

import pytest
from helpers import duck, rows_of

from vecfolio.plans.queries import ORACLE_SQL, QUERIES


def laid(spark, small, folder, files):
    """``embeddings`` as a folder of so many files, or one plain file; beside it a folder with a file of the table's name."""
    path = folder / "embeddings.parquet"
    if files:
        spark.read.parquet(f"{small}/embeddings.parquet").repartition(files).write.parquet(str(path))
    else:
        shutil.copy(f"{small}/embeddings.parquet", path)
    (folder / "other").mkdir()
    shutil.copy(f"{small}/embeddings.parquet", folder / "other" / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("files", [0, 1, 3])
def test_refreshed_profiles_of_any_number_of_files(spark, small, tmp_path, files):
    folder = laid(spark, small, tmp_path, files)
    found = QUERIES["stream_refreshed_profiles"](spark, folder).toPandas()
    wanted = duck(small, ["embeddings"]).execute(ORACLE_SQL["stream_refreshed_profiles"]).df()
    assert len(found) and rows_of(found) == rows_of(wanted)


@pytest.mark.parametrize("files", [0, 1, 3])
def test_global_vectors_of_any_number_of_files(spark, small, tmp_path, files):
    folder = laid(spark, small, tmp_path, files)
    found = QUERIES["stream_profile_global"](spark, folder).toPandas()
    wanted = duck(small, ["embeddings"]).execute(ORACLE_SQL["stream_profile_global"]).df()
    assert len(found) and rows_of(found) == rows_of(wanted)


def test_refreshed_profiles_of_no_rows(spark, small, tmp_path):
    spark.read.parquet(f"{small}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert not QUERIES["stream_refreshed_profiles"](spark, str(tmp_path)).count()
