import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.config import Config
from stratalith.functions import policy, text, vector


def one(spark, column, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).withColumns(names).select(column.alias("x")).collect()[0]["x"] if names else spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_tokens_and_estimates(spark):
    assert one(spark, text.estimate_tokens(F.lit("abcde中文ab"))) == 2 + 2 + 1
    assert one(spark, text.estimate_tokens(F.lit(None).cast("string"))) == 0
    assert set(one(spark, text.lexical_tokens(F.lit("The Parser-2 took 3.5 ms，配置项")))) == {"the", "parser-2", "took", "3.5", "ms", "配置项", "配置", "置项"}
    assert one(spark, text.informative_tokens(F.lit("the user is a parser x"))) == ["parser"]
    assert one(spark, text.encoder_tokens(F.lit("a a 中"))) == ["a", "a", "中"]


def test_decompose(spark):
    got = one(spark, text.decompose(F.lit("Which port does the gateway use; who owns the billing service and where are the backup files stored?")))
    assert len(got["subqueries"]) == 3
    single = one(spark, text.decompose(F.lit("Which port does the gateway use")))
    assert single["subqueries"] == [] and single["rejected"][0]["reason"] == "duplicate"
    poor = one(spark, text.decompose(F.lit("hello; list all failing gateway checks")))
    assert poor["rejected"][0]["reason"] == "low-information" and len(poor["subqueries"]) == 1


def test_remember_and_json(spark):
    got = one(spark, text.remember(F.lit("请记住：全局：部署在周五进行")))
    assert got["content"] == "部署在周五进行" and got["scope_kind"] == "user-global"
    assert one(spark, text.remember(F.lit("不要记住这件事"))) is None
    assert text.last_json('first {"a": 1} then {"b": [2, {"c": 3}]} end') == '{"b": [2, {"c": 3}]}'
    assert text.last_json("```json\n{\"a\": 1}\n```") == '{"a": 1}' and text.last_json("none") is None


def test_vectors(spark):
    assert one(spark, vector.fnv32(F.lit("ab"))) == 1294271946
    a = one(spark, vector.feature_hash(F.lit("alpha beta beta"), 64))
    assert len(a) == 64 and math.isclose(sum(x * x for x in a), 1, abs_tol=1e-4)
    arrays = lambda x: F.lit(None).cast("array<double>") if x is None else F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vector.cosine(arrays([1, 2]), arrays([2, 4]))) == pytest.approx(1)
    for b in (None, [0, 0], [1, 2, 3], [float("nan"), 1]):
        assert one(spark, vector.cosine(arrays([1, 2]), arrays(b))) == 0


def test_http_encoder(spark):
    def post(path, body):
        return {"model": "m", "revision": "r", "dimensions": 2, "vectors": [[1.0, 0.0] for _ in body.get("texts", [])]}

    encoder = vector.http_encoder("", "m", "r", 2, post=post)
    encoder.health()
    out = list(encoder.encode(iter([pd.Series(["a", None, "b"])]), "query"))[0]
    assert out[0] == [1.0, 0.0] and out[1] is None
    wrong = vector.http_encoder("", "other", "r", 2, post=post)
    assert list(wrong.encode(iter([pd.Series(["a"])]), "query"))[0][0] is None
    with pytest.raises(ValueError):
        list(vector.http_encoder("", "other", "r", 2, post=post, required=True).encode(iter([pd.Series(["a"])]), "query"))
    assert vector.hash_encoder().vectors(spark.createDataFrame([("alpha",)], "t string"), "t").collect()[0]["vector"]


def test_policy(spark):
    uses = spark.createDataFrame([("i", "s1", 1, 5, 1.0, True), ("i", "s1", 1, 6, 9.0, True), ("i", "s2", 9, 5, 1.0, True), ("i", "s2", None, 5, 1.0, True)], "item_id string, session_id string, turn int, h int, weight double, verified boolean")
    uses = uses.withColumn("at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h)")).drop("h")
    distinct = policy.distinct_uses(uses)
    assert distinct.count() == 2
    fact = policy.use_facts(distinct, F.expr("timestamp_ntz'2024-01-02 05:00:00'"), F.lit(9)).collect()[0]
    assert fact["activation"] == pytest.approx(math.log(9**-0.5 * 0.5 + 0.5)) and fact["strong"] == 2 and fact["sessions"] == 2
    assert one(spark, policy.to_bank(F.lit(True), F.lit("decision"), F.lit(3), F.lit(2), F.lit(0.1), F.lit(0.1), F.lit(False)))
    assert one(spark, policy.expires(F.lit(False), F.lit(False), F.lit(13), F.lit(1.0), F.lit(-2.0)))
    assert not one(spark, policy.expires(F.lit(True), F.lit(False), F.lit(13), F.lit(1.0), F.lit(-2.0)))


def test_clamps():
    c = Config(parent_max_tokens=10, context_pressure_ratio=2.0)
    assert (c.parent_max_tokens, c.parent_target_tokens, c.context_pressure_ratio) == (96, 96, 0.95)


def test_clip(spark):
    assert text.clip("abcdefgh", 1) == "abcd" and text.clip("abcdefgh", 1, end=True) == "efgh" and text.clip("中文", 1) == "中" and text.clip("中", 0) == ""
    assert one(spark, text.clip_to_tokens(F.lit("a" * 50), 3)) == "a" * 12
    assert one(spark, text.estimate_input_tokens(F.lit("abcd"), F.array(F.lit("x")), F.array(F.lit("y")))) == 1 + 2 + 2
