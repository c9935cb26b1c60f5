import pytest

from keystrata.functions.glob import PatternError, compile_glob, glob_match

#: pattern: keys that match | keys that don't
TABLE = {
    "hello": "hello | world hello! hell",
    "hel*": "hel help hel/p:x | he ahel",
    "*end": "end theend | ends en",
    "a*z": "az a-z a/b/z | a za azb",
    "*a*b*": "ab xaxbx aabb | ba a b",
    "?": "a é | ab",
    "c?t": "cat c:t | ct coat",
    "???": "abc ::: | ab abcd",
    "[xyz]": "x y z | w xy",
    "[b-d]": "b c d | a e B",
    "[d-b]": "b c d | a e",
    "[^xyz]": "a X | x y z",
    "[!xyz]": "a | x z",
    "[^]": "a | ab",
    "[a-cX-Z0-1]": "a Z 0 | d W 2",
    "p/**/q": "p/a/q p//q p/a/b/q | p/q pq",
    "k:*:n": "k:1:n k::n k:1:2:n | k:n k:1",
    r"a\*b": "a*b | axb a",
    r"\[x\]": "[x] | x",
    r"q\?": "q? | qa q",
    r"a\\b": "a\\b | ab",
    "a.b+c": "a.b+c | axb+c a.bbc",
}


@pytest.mark.parametrize("pattern", TABLE)
def test_table(pattern):
    yes, no = (part.split() for part in TABLE[pattern].split("|"))
    assert all(glob_match(pattern, k) for k in yes)
    assert not any(glob_match(pattern, k) for k in no)


def test_empty_keys_and_lines():
    assert glob_match("*", "") and glob_match("**", "") and not glob_match("?", "") and not glob_match("[]", "a")
    assert not glob_match("ab", "ab\n") and glob_match("a*", "a\nb")


@pytest.mark.parametrize("bad", ["", "[abc", "x[", "[^"])
def test_bad(bad):
    with pytest.raises(PatternError):
        compile_glob(bad)


@pytest.mark.parametrize("pattern,prefix,literal", [("key", "key", True), ("key*", "key", False), ("k?y", "k", False), ("[k]ey", "", False), ("u:1:*", "u:1:", False), (r"a\*b*", "a*b", False)])
def test_prefix(pattern, prefix, literal):
    p = compile_glob(pattern)
    assert (p.prefix, p.is_literal) == (prefix, literal)


def test_column_agrees_with_python(spark):
    from pyspark.sql import functions as F

    keys = sorted({k for part in TABLE.values() for k in part.replace("|", " ").split()})
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    cols = [compile_glob(p).condition(F.col("key")).alias(str(i)) for i, p in enumerate(TABLE)]
    for r in df.select("key", *cols).collect():
        assert [r[str(i)] for i in range(len(TABLE))] == [glob_match(p, r.key) for p in TABLE]


def test_bytes_and_pushdown(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("é",), ("a",)], "key string")
    assert [r.key for r in df.where(compile_glob("?").condition(F.col("key"), byte_wise=True)).collect()] == ["a"]
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).where(compile_glob("a*").condition(F.col("key")))
    assert "StringStartsWith(key,a)" in read._jdf.queryExecution().executedPlan().toString()


def test_an_escaped_member_begins_no_range():
    assert [c for c in "a-mz\\" if compile_glob(r"[\a-z]").matches(c)] == ["a", "-", "z"]
