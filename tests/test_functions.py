from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import clex, records
from tallyforge.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "Unsupported Instruction @ 0x40A1, 12 times!", X.normalize_reason) == "unsupported instruction _ <address>_ <n> times"
    assert one(spark, "", X.normalize_reason) == "unknown"
    assert [one(spark, x, X.reason_category) for x in ("unsupported x", "file not found", "timed out", "blocked", "fine")] == ["unsupported", "missing", "timeout", "blocked", None]
    assert one(spark, "std::__builtin_memcpy@GLIBC_2.2", X.operation_name) == "memcpy"
    assert [one(spark, x, X.address) for x in ("0X00401a", "401A", "zz", "0")] == ["0x401a", "0x401a", None, "0x0"]
    assert [one(spark, x, X.integer_literal) for x in ("0x1fUL", "017", "42u", "'A'", "-8", "n", "0xffffffffffffffff", "0x00000000000000001")] == [31, 15, 42, 65, -8, None, 2**64 - 1, 1]
    assert one(spark, "cwe-121 and CWE_0078, CWE-121", X.cwe) == ["CWE-121", "CWE-78"]
    assert one(spark, "/usr/bin/Tool-1.ELF", X.binary_key) == "tool_1"
    assert one(spark, "((char *)(uint)(x))", X.cast_stripped) == "x"
    assert one(spark, "((((((((int)(((long)(y + 1))))))))))", X.cast_stripped) == "y+1"
    assert one(spark, "aB3dE6gH9jK2mN5pQ8sT", X.token_shape) and not one(spark, "a" * 30, X.token_shape) and not one(spark, "exampleAB3dE6gH9jK2mN5p", X.token_shape)
    assert one(spark, "input stage", lambda c: X.blocker_stage(F.lit(None).cast("string"), c)) == "input_topology"


def test_c_lexing():
    assert clex.strip_comments('a /* x */ b // c\n"// no"') == 'a   b  \n"// no"'
    assert clex.split_arguments('a, f(b, c), "x,y", {1, 2}') == ["a", "f(b, c)", '"x,y"', "{1, 2}"]
    assert clex.calls('if (x) foo(bar(1), "a)b");') == [("foo", ["bar(1)", '"a)b"'], 1), ("bar", ["1"], 1)]
    assert clex.affine("4*(n + 2) - n") == (8, {"n": 3}) and clex.affine("a*b") is None and clex.affine("(1") is None
    assert [clex.constant(x) for x in ("1 << 4 | 3", "-7 / 2", "0x10 % 7", "010", "x", "1/0")] == [19, -3, 2, 8, None, None]
    assert clex.string_length(r'"a\n" "\x41b"') == 3 and clex.string_length("x") is None
    assert clex.scanf_conversions("%d %*s %10s %[^\n] %%") == [("d", None), ("s", 10), ("[", None)]


@given(st.recursive(st.integers(0, 50).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_constants_equal_python(text):
    assert clex.constant(text) == (eval(text) if abs(eval(text)) < 1 << 63 else None)


def test_records(spark):
    df = spark.createDataFrame([(1, (2, (0.5, "x")), {"token": "t", "a": "b"}, "s3")], "id int, m struct<n:int,d:struct<r:double,t:string>>, kv map<string,string>, password string")
    assert {(r.metric, r.value) for r in records.flatten_numbers(df, "id").collect()} == {("m.n", 2.0), ("m.d.r", 0.5)}
    r = records.redact(df).first()
    assert r.password == "<redacted>" and r.kv == {"token": "<redacted>", "a": "b"} and r.m.n == 2
    assert df.select(records.canonical_json(df, ["password", "id"])).first()[0] == '{"id":1,"password":"s3"}'
    udf = spark.createDataFrame([("f(a, g(b))",)], "x string").select(clex.calls_udf("x").alias("c")).first().c
    assert [(c.name, c.args) for c in udf] == [("f", ["a", "g(b)"]), ("g", ["b"])]
