"""Hand-derived vectors for text, URL and JSON functions."""

import pytest
from pyspark.sql import functions as F

from kbforge.functions import text as X
from kbforge.functions import urls as U
from kbforge.sources import jsonl


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "url,base,enhanced",
    [
        ("http://A.com/", "http://A.com", "http://a.com/"), ("http://A.com", "http://A.com", "http://a.com"), ("HTTP://A.com/X/", "HTTP://A.com/X", "http://a.com/X"),
        ("http://a.com/x//", "http://a.com/x", "http://a.com/x/"), ("http://a.com/x#f/", "http://a.com/x", "http://a.com/x"), ("http://a.com/x/?utm_source=z", None, "http://a.com/x"),
        ("http://a.com/x/?a=1&utm_medium=q&b=", None, "http://a.com/x/?a=1&b="), ("http://a.com/?q=a%20b", None, "http://a.com/?q=a+b"), ("http://a.com/?q=校", None, "http://a.com/?q=%E6%A0%A1"),
        ("http://a.com/p;v=1?From=x", None, "http://a.com/p"), ("a.com/x/", "a.com/x", "a.com/x"), ("http:\\\\a.com\\x", None, "http://a.com/x"), ("http://a.com//", "http://a.com", "http://a.com/"), ("", "", ""),
    ],
)
def test_url_forms(spark, url, base, enhanced):
    assert one(spark, url, U.url_norm_base) == (url if base is None else base)
    assert U.normal_url(url) == enhanced and one(spark, url, U.url_norm) == enhanced


def test_questions(spark):
    assert one(spark, " 校园 卡？ ", X.question_norm) == "校园卡?" and one(spark, "a　B", X.question_norm) == "aB"
    assert one(spark, "x", lambda c: X.question_id(F.lit("given"), c)) == "given"


def test_pick_first(spark):
    row = spark.createDataFrame([(None, " x ", 0, "  ")], "a string, b string, n int, e string")
    assert row.select(X.pick_first(F.col("a"), F.col("b"))).first()[0] == "x"
    assert row.select(X.pick_first(F.col("n"), F.col("b"))).first()[0] == "0"
    assert row.select(X.pick_first(F.col("a"), F.col("e"))).first()[0] == ""


def test_content_hash_prefixes(spark):
    a, b = "x " * 9000 + "a", "x " * 9000 + "b"
    assert one(spark, a, lambda c: X.content_hash(c, 8000)) == one(spark, b, lambda c: X.content_hash(c, 8000))
    assert one(spark, a, X.content_hash) != one(spark, b, X.content_hash) or 9000 >= 12000


def test_shorten_and_lines(spark):
    assert one(spark, " a\nb ", lambda c: X.shorten(c, 3)) == "a b" and one(spark, "abcd", lambda c: X.shorten(c, 3)) == "abc..."
    assert one(spark, "a  b\n　\nabc\n", lambda c: X.clean_lines(c, 3)) == ["a b", "abc"]
    assert one(spark, ["a", "a", "b", "a"], X.collapse_runs, "array<string>") == ["a", "b", "a"]


def test_json_cleanup(spark):
    fenced, around = '```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} ok'
    assert one(spark, fenced, X.json_clean) == '{"a": 1}' and one(spark, around, X.json_clean) == around
    assert one(spark, around, lambda c: X.json_clean(c, True)) == '{"a": {"b": 2}}' and one(spark, "none", lambda c: X.json_clean(c, True)) == "none"


def test_domains(spark):
    f = lambda c: F.struct(U.domain_allowed_base(c, ["d.tld"]).alias("b"), U.domain_allowed(c, ["d.tld"]).alias("e"), U.domain_allowed(c, ["d.tld"], True).alias("s"))
    assert one(spark, "http://x/?u=d.tld", f) == (True, True, False)
    assert one(spark, "http://D.TLD/", f) == (False, True, True) and one(spark, "http://a.d.tld/x", f) == (True, True, True)


@pytest.mark.parametrize("url,want", [("http://a/x.pdf", True), ("http://a/x.jpg", False), ("http://a/login.pdf", False), ("http://a/x.jpeg", False), ("http://a/list", True), ("http://a/x?图书馆", True)])
def test_useful_link(spark, url, want):
    assert one(spark, url, lambda c: U.useful_link(c, F.lit(""), F.lit(""))) is want


@pytest.mark.parametrize(
    "url,kind,want",
    [("http://a/x", "application/pdf", "html"), ("http://a/x.pdf", "", "pdf"), ("http://a/x.docx", "", "docx"), ("http://a/x.xlsx", "", "xlsx"), ("http://a/x.doc", "", "unsupported_doc"), ("http://a/x.zip", "a/zip", "unsupported_content_type"), ("http://a.com", "", "html")],
)
def test_content_route(spark, url, kind, want):
    assert one(spark, url, lambda c: U.content_route(c, F.lit(kind))) == want


def test_record_text(spark):
    t = one(spark, "q", lambda c: X.rerank_doc_text(c, F.lit("a"), F.lit("i"), F.lit("k"), F.lit(" "), F.lit("u")))
    assert t == "问题：q\n答案：a\n类别：k\n来源链接：u"
    assert one(spark, " ", lambda c: X.rerank_doc_text(c, F.lit(None).cast("string"), F.lit("i"), F.lit(None).cast("string"), F.lit(""), F.lit(""))) == "i"
    assert one(spark, " ", lambda c: X.evidence(c, F.lit("z" * 300))) == "z" * 250 and len(one(spark, "e" * 600, lambda c: X.evidence(c, F.lit("z")))) == 500


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"query": "q1", "response": "a1"}\n\n{bad\n{"x": 1} trailing\n{"question": "q2", "answer": 0}\n[1, 2]\n', encoding="utf-8")
    items = {r.id: r for r in jsonl.qa_items(jsonl.lines(spark, str(path))).collect()}
    assert sorted(items) == [0, 4, 5] and (items[0].question, items[0].answer) == ("q1", "a1") and items[4].answer == "0" and items[5].answer == "[1, 2]"
    assert items[0].index_text == "问题：q1\n答案：a1"
    assert jsonl.lines(spark, str(tmp_path / "none")).count() == 0 and jsonl.scan_tolerant(spark, str(path)).count() == 3
    with pytest.raises(Exception):
        jsonl.scan_strict(spark, str(path), "query string").collect()
    out = str(tmp_path / "out")
    jsonl.append(spark.range(2), out)
    jsonl.append(spark.range(3), out)
    assert spark.read.json(out).count() == 5


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from kbforge import scratch

    conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://h:7077"))
    assert scratch.shared_dir(spark) == "hdfs://x/y"
    conf.clear()
    with pytest.raises(ValueError):
        scratch.shared_dir(spark)


def test_only_absent_modules_are_passed_over(tmp_path, monkeypatch):
    import __spark_entry__ as entry

    (tmp_path / "broken_one.py").write_text("import no_such_module_here")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._present("no_such_package.queries") is None
    with pytest.raises(ModuleNotFoundError):
        entry._present("broken_one")
