"""Settings and record contracts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect import config
from recollect.functions import contracts


def test_overlay(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[brief]\nglobal_budget = 100\n[formulas]\npage = "best * 2"\n')
    got = config.load(str(path))
    assert got["brief"]["global_budget"] == 100 and got["formulas"]["page"] == "best * 2"
    assert config.load() == config.DEFAULTS


@pytest.mark.parametrize("text", ["[other]\nx = 1", "[brief]\nnope = 1", "[brief]\ndecay = 1.5", "[retrieval]\nrrf_k = -1", '[formulas]\npage = "exp(best)"', '[brief]\ndecay = "x"'])
def test_bad_settings(tmp_path, text):
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.toml"))


def test_paths(tmp_path):
    assert config.folder_path("a/../b", str(tmp_path)) == str((tmp_path / "b").resolve())


KIND = T.StructType([T.StructField("line", T.StringType(), False), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType(), False))])


def test_json_schema():
    got = contracts.json_schema(KIND)
    assert got["required"] == ["line"] and got["properties"]["n"] == {"anyOf": [{"type": "integer"}, {"type": "null"}]}
    assert got["additionalProperties"] is False


@pytest.mark.parametrize(("payload", "want"), [('{"line":"x","n":1,"tags":["a"]}', None), ('{"line":"x"}', None), ('{"n":1}', "missing field line"), ('{"line":"x","y":1}', "unknown field y"), ("[1]", "not a JSON object"), ('{"line":"x"} {}', "not a JSON object"), ('{"line":"x","n":"y"}', "wrong type of n")])
def test_strict_decoding(spark, payload, want):
    assert spark.range(1).select(contracts.decode_problem(F.lit(payload), KIND)).first()[0] == want


def test_fingerprint(spark):
    assert len(spark.range(1).select(contracts.fingerprint(F.lit("a"), F.lit("b"))).first()[0]) == 12
