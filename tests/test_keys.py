import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofline.functions import keys, scalars
from proofline.functions.register import register

NUMBERS = {"1": "1", "1.0": "1", "1.00": "1", "1.50": "1.5", "1e3": "1000", "-0": "0", "-0.0": "0", "007": "7", "+5": "5", ".5": "0.5",
           "5.": "5", "12345678.5": "12345678.5", "1e-7": "0.0000001", "-1.5E-10": "-0.00000000015", "0.85": "0.85",
           "123456789012345678901234567890123456789012": "123456789012345678901234567890123456789012",
           "1e400": None, "5d": None, " 5": None, "nan": None, "inf": None, "Infinity": None, "": None, "1e": None, "--1": None, ".": None}


def one(spark, tokens, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_canonical_number(spark):
    got = one(spark, list(NUMBERS), keys.canonical_number(F.col("x")))
    assert {t: g[0] for t, g in zip(NUMBERS, got)} == NUMBERS


def test_canonical_number_matches_python_floats(spark):
    rng = random.Random(7)
    tokens = [repr(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12)) for _ in range(300)]
    want = []
    for t in tokens:
        text = format(Decimal(repr(float(t))), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        want.append("0" if text == "-0" else text)
    assert [g[0] for g in one(spark, tokens, keys.canonical_number(F.col("x")))] == want


@pytest.mark.parametrize("ladder, cases", [
    (keys.csv_key, {"": "null", "null": "str:null", "TRUE": "bool:true", "False": "bool:false", "1.00": "number:1", " 5": "str: 5", "'a'": "str:'a'"}),
    (keys.token_key, {"": "null", " ": "null", "null": "null", "~": "null", "TRUE": "str:TRUE", "true": "bool:true", " 5 ": "number:5",
                      "'1'": "str:1", '"1"': "str:1", "'": "str:'", "NULL": "str:NULL"}),
])
def test_ladders(spark, ladder, cases):
    got = one(spark, list(cases), keys.key_token(ladder(F.col("x"))))
    assert {t: g[0] for t, g in zip(cases, got)} == cases


def test_null_text_is_null(spark):
    assert one(spark, [None], keys.key_token(keys.csv_key(F.col("x"))), keys.key_token(keys.token_key(F.col("x")))) == [("null", "null")]


def test_typed_keys(spark):
    df = spark.sql("""select 1 as i, 1.0D as d, cast(1.50 as decimal(10,4)) as m, 'x' as s, true as b, double('NaN') as n, array(1, 2) as a,
        named_struct('k', 1) as o, cast(null as int) as z, timestamp_ntz'2024-01-02 03:04:05' as t, date'2024-01-02' as day, '1' as quoted""")
    got = df.select(*[keys.key_token(keys.typed_key(F.col(f.name), f.dataType)) for f in df.schema.fields]).collect()[0]
    assert list(got) == ["number:1", "number:1", "number:1.5", "str:x", "bool:true", "str:NaN", "str:[1,2]", 'str:{"k":1}', "null",
                         "str:2024-01-02T03:04:05.000000", "str:2024-01-02", "str:1"]


def test_row_key_is_injective(spark):
    cells = ["a", "a|str:x", "x|str:b", "b", "", "3:", "ä", "1:a"]
    pairs = [(x, y) for x in cells for y in cells]
    df = spark.createDataFrame(pairs, "x string, y string")
    key = keys.row_key([keys.typed_key(F.col(c), df.schema[c].dataType) for c in ("x", "y")])
    assert df.select(key.alias("k")).distinct().count() == len(pairs)


def test_absent_is_not_null(spark):
    got = spark.range(1).select(keys.key_token(keys.absent_key()), keys.key_token(keys.cell_key("null"))).collect()[0]
    assert tuple(got) == ("absent", "null")


def test_paths_names_and_types(spark):
    df = spark.range(1)
    path = lambda p, root=None: df.select(scalars.normalize_path(F.lit(p), root)).collect()[0][0]
    assert path("./././a//b") == "a/b" and path("a\\b\\\\c") == "a/b/c" and path("proj/models/x.sql", "proj") == "models/x.sql"
    assert path("project/x.sql", "proj") == "project/x.sql" and path("proj", "proj/") == "" and path("proj//x", "proj") == "/x"
    get = lambda e: df.select(e).collect()[0][0]
    assert tuple(get(scalars.parse_relation(F.lit('"Db"."s.x"."T"')))) == ("db", "s.x", "t")
    assert tuple(get(scalars.parse_relation(F.lit("T")))) == (None, None, "t")
    assert get(scalars.input_leaf(F.lit("ref('p', 'B')"))) == "b" and get(scalars.input_leaf(F.lit("select 1"))) is None
    assert get(scalars.bare_name(F.lit("model.p.n.v2"))) == "n" and get(scalars.bare_name(F.lit("n.v2"))) == "v2"
    assert get(scalars.canonical_type(F.lit("VARCHAR(20)"))) == "string" and get(scalars.canonical_type(F.lit(" Int4"))) == "integer"


def test_deprecation_state(spark):
    today = F.lit("2024-05-01").cast("date")
    get = lambda raw: spark.range(1).select(scalars.deprecation_state(F.lit(raw), today)).collect()[0][0]
    assert tuple(get("2024-05-02")) == ("scheduled", "info") and tuple(get("2024-05-01")) == ("elapsed", "danger")
    assert get("soon") is None and get("2024-13-01") is None and tuple(get("2024-02-31")) == ("elapsed", "danger")


def test_text_references(spark, rows):
    text = "{{ var('a') }} var('outside') {% if var(x) and var(\"b\", 1) %}{{ var('a') }}"
    df = spark.createDataFrame([(1, text), (2, "no templates")], "id int, t string")
    assert rows(scalars.text_references(df, "id", "t")) == [(1, "a", False), (1, "b", False), (1, None, True)]


def test_text_references_skip_comments_and_raw_blocks(spark, rows):
    text = ("{# var('no') #}{% raw %}{{ var('no') }}{% endraw %}{{ {'k': {'v': var('deep')}} }} {{ \"}}\" ~ var( 'late' ) }} {{ myvar('no') }}"
            " {{ x.var('no') }} {{ var.has_var('has') }}{{ var('') }}{%- set a = var(b) -%} {{ var('open")
    df = spark.createDataFrame([(1, text), (2, "{{ " + "x " * 50000 + "var('far') }}")], "id int, t string")
    assert rows(scalars.text_references(df, "id", "t")) == [
        (1, "", False), (1, "deep", False), (1, "has", False), (1, "late", False), (1, None, True), (2, "far", False)]


def test_mask_hash_surrogate_bucket(spark):
    get = lambda e: spark.range(1).select(e).collect()[0][0]
    assert get(scalars.mask(F.lit("x"), False)) == "***" and get(scalars.mask(F.lit("x"), F.lit(None).cast("boolean"))) == "***"
    assert get(scalars.surrogate_key([F.lit(""), F.lit("a")])) != get(scalars.surrogate_key([F.lit(None), F.lit("a")]))
    assert [get(scalars.bucket(F.lit(v), ((0, "0"), (10, "1-10")), "more", inclusive=True)) for v in (0, 10, 11)] == ["0", "1-10", "more"]
    assert get(scalars.guarded_ratio(F.lit(1.0), F.lit(0.0), 4)) == 0.0


def test_sql_functions_agree_with_columns(spark):
    register(spark)
    tokens = [t for t in NUMBERS]
    df = spark.createDataFrame([(t,) for t in tokens], "x string")
    df.createOrReplaceTempView("tokens")
    via_sql = spark.sql("select x, pl_number(x) n, pl_csv_token(x) c from tokens").collect()
    via_columns = df.select("x", keys.canonical_number(F.col("x")).alias("n"), keys.key_token(keys.csv_key(F.col("x"))).alias("c")).collect()
    assert sorted(map(tuple, via_sql), key=str) == sorted(map(tuple, via_columns), key=str)
    assert spark.sql("select pl_type('VARCHAR(3)'), pl_bare_name('a.b.c.v1'), pl_path('./a//b'), pl_mask('x', false)").collect()[0] == (
        "string", "c", "a/b", "***")


def test_infinite_double_is_text(spark):
    df = spark.createDataFrame([(math.inf,)], "x double")
    assert df.select(keys.key_token(keys.typed_key(F.col("x"), df.schema["x"].dataType))).collect()[0][0] == "str:Infinity"


def test_sql_functions_agree_with_columns(spark):
    register(spark)
    texts = ["ref('a', 'B')", "source(\"x\", \"Y\")", "plain", 'Db."My.Schema".[Tab]', "a.b.c.d", "", None, "x'y", "`q`.z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(F.expr("pl_relation(t)").alias("a"), scalars.parse_relation(F.col("t")).alias("b"), F.expr("pl_input_leaf(t)").alias("c"), scalars.input_leaf(F.col("t")).alias("d"),
                     F.expr("pl_surrogate_key(array(t, 'k'))").alias("e"), scalars.surrogate_key([F.col("t"), F.lit("k")]).alias("f"),
                     F.expr("pl_bucket(length(t), array(3, 6), array('low', 'mid'), 'high')").alias("g"), scalars.bucket(F.length("t"), [(3, "low"), (6, "mid")], "high").alias("h"),
                     F.expr("pl_row_key(array(coalesce(t, 'n'), 'é'))").alias("i"), F.expr("concat(octet_length(coalesce(t, 'n')), ':', coalesce(t, 'n'), '2:é')").alias("j"))
    for r in both.collect():
        assert (r.a, r.c, r.e, r.g, r.i) == (r.b, r.d, r.f, r.h, r.j)
    typed = spark.sql("select 1.50BD as a, 7 as b, 2.5D as c, true as d, 'x' as e, cast(null as int) as f, 100 as g, 10.00BD as h, -0.0D as i, double('nan') as j")
    for name, kind in typed.dtypes:
        row = typed.select(F.expr(f"pl_typed(cast({name} as variant))").alias("a"), keys.key_token(keys.typed_key(F.col(name), typed.schema[name].dataType)).alias("b")).first()
        assert row.a.lower() == row.b.lower(), (name, kind, row)
