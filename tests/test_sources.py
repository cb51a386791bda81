"""Character sets, the crawl from seeds to records, key stores, streams that survive a retry, numbered lines, keyword tables, pruned search."""

import collections
import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.config import Config
from kbforge.functions import urls
from kbforge.operators import dedup, keywords, retrieval
from kbforge.plans import crawl as plan
from kbforge.sources import charset, connectors, jsonl
from kbforge.sources.keystore import KeyStore
from kbforge.streaming import judged

TEXTS = {
    "gb18030": ["校园卡丢失后请尽快到学生服务中心挂失并补办新卡，办理时需携带身份证。", "图书馆开放时间为每天早上八点到晚上十点。"],
    "big5hkscs": ["校園卡遺失後請盡快到學生服務中心掛失並補辦新卡，辦理時需攜帶身份證。", "圖書館開放時間為每天早上八點到晚上十點。"],
    "euc_jp": ["学生証を紛失した場合は、すぐに学生課へ届け出てください。", "図書館は毎日午前八時から午後十時まで開いています。"],
    "cp932": ["学生証を紛失した場合は、すぐに学生課へ届け出てください。"],
    "cp949": ["학생증을 분실한 경우에는 즉시 학생지원센터에 신고해야 합니다.", "도서관은 매일 오전 여덟 시부터 밤 열 시까지 운영합니다."],
    "cp1252": ["Die Studierenden müssen sich für die Prüfung rechtzeitig anmelden, schöne Grüße.", "Los alumnos españoles están aquí, ¿qué pasó?", "élève à l’école où ça déjà été"],
    "cp1251": ["Студенты должны зарегистрироваться до начала экзамена.", "Библиотека открыта каждый день."],
    "koi8_r": ["Студенты должны зарегистрироваться до начала экзамена."],
    "utf-8": ["Größe 校园卡", "plain"],
    "utf-16-le": ["Plain text and 校园"],
}


@pytest.mark.parametrize("name", sorted(TEXTS))
@pytest.mark.parametrize("page", ["{}", "<html><head><title>x</title></head><body><p>{}</p></body></html>", "<meta charset=utf-8><p>{}", "<meta http-equiv=Content-Type content='text/html; charset=iso-8859-1'>{}"])
def test_charset_by_bytes(name, page):
    """Declarations that are wrong don't win."""
    for text in TEXTS[name]:
        whole = page.format(text)
        assert charset.decode(whole.encode(name)) == (whole, name)


def test_charset_words_count_once_and_words_of_two_scripts_count_against():
    """Short words of accented letters alone look like another script's: neither their number nor letters next to each other decide."""
    for text in ("Éé " * 39 + "éonsggs " * 18 + "anré Größe und élève, señor", "die üß " * 29 + "für die Größe und élève, señor", "éé. ççè èé è èêè Èou ciónes Vireè queauxè èçonan ééen éanou Größe und élève, señor"):
        assert charset.decode(text.encode("cp1252")) == (text, "cp1252")
    for name in ("cp1251", "koi8_r"):
        text = "Студенты " * 30 + "и IT-отдел должны зарегистрироваться в Moodle до начала экзамена"
        assert charset.decode(text.encode(name)) == (text, name)


def test_charset_marks_declarations_and_damage():
    for mark, name in (("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("utf-32", "utf-32")):
        assert charset.decode("Größe".encode(mark)) == ("Größe", name)
    assert charset.decode(b"") == ("", "utf-8") and charset.decode(None) == (None, None)
    # what the bytes leave open, the declaration decides; names that are no text codecs are passed over
    greek = "Η βιβλιοθήκη".encode("iso8859-7")
    assert charset.decode(greek, "text/html; charset=ISO-8859-7")[0] == "Η βιβλιοθήκη"
    assert charset.known("gb2312") == "gb18030" and charset.known("latin1") == "cp1252" and charset.known("base64") is None and charset.known("no-such") is None
    assert charset.detect("校园".encode()[:-1] + b"") == "utf-8"  # a character cut at the end
    text, name = charset.decode("校园卡丢失后请尽快到学生服务中心".encode("gb18030") + b"\xff")
    assert name == "gb18030" and text.startswith("校园卡丢失")


def _docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


LONG = "guide " * 60
WEB = {  # url: (final url, type, body)
    "http://h/a": ("http://h/a", "text/html", f"<title>A</title><main>{LONG}<a href='/b'>faq one</a><a href='/c.docx'>the file</a><a href='http://other/list'>x</a></main>".encode()),
    "http://h/b": ("http://H/b#x", "text/html; charset=gb2312", f"<main>学生服务中心的校园卡办理说明 {LONG}<a href='/d'>faq deep</a><a href='/a'>faq back</a></main>".encode("gb18030")),
    "http://h/c.docx": ("http://h/c.docx", "", _docx(LONG + "docx")),
    "http://h/d": ("http://h/d", "", f"<title>D</title><main>{LONG}same<a href='/e'>faq far</a></main>".encode()),
    "http://h/bad.docx": ("http://h/bad.docx", "", b"no archive"),
    "http://h/x.bin": ("http://h/x.bin", "application/Octet-Stream", b"\0"),
    "http://h/s": ("http://h/s", "", b"<main>short</main>"),
    "http://h/twin": ("http://h/twin", "", f"<title>T</title><main>{LONG}same</main>".encode()),
    "http://h/pdf": ("http://h/f.x", "application/x-pdf", b"%PDF damaged"),
}


def _fetch(urls_df):
    rows = [(u, *w, None) for u, w in WEB.items()]
    web = urls_df.sparkSession.createDataFrame(rows, "url string, final_url string, content_type string, body binary, error string")
    return urls_df.join(web, "url", "left").withColumn("error", F.when(F.col("body").isNull(), "timeout"))


def _reply(pages):
    return pages.select("ord", F.when(F.col("url").endswith("/a"), '{"useful": false, "reason": "no"}').otherwise('{"useful": true, "category": "guide"}').alias("reply"))


def _pairs(chunks):
    return chunks.select("ord", "chunk_id", F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("What of "), "url").alias("question"), F.lit("an answer").alias("answer"))).alias("qa_pairs"))).alias("reply"))


def test_crawl_from_seeds_to_records(spark):
    seeds = spark.createDataFrame([(0, "http://H/a#top"), (1, "http://h/bad.docx"), (2, "http://h/a"), (3, "http://elsewhere.example/")], "ord long, url string")
    hits = spark.createDataFrame([(0, "http://h/x.bin", "bin", "s"), (1, "http://h/s", "a hit", None), (2, "http://h/gone", None, None), (3, "http://h/twin", "t", None), (4, "http://h/bad.docx", None, None), (5, "http://h/pdf", None, None)], "ord long, url string, title string, snippet string")
    queue = plan.frontier(seeds, hits, ("//h",))
    assert [r.url for r in queue.orderBy("ord").collect()] == ["http://h/a", "http://h/bad.docx", "http://h/x.bin", "http://h/s", "http://h/gone", "http://h/twin", "http://h/pdf"]
    got = plan.run(queue, _fetch, _reply, _pairs, ("//h",), Config(max_depth=2))
    pages = {r.asked: r for r in got.pages.collect()}
    assert pages["http://h/b"].url == "http://h/b" and pages["http://h/b"].charset == "gb18030" and pages["http://h/b"].content.startswith("学生服务中心")
    assert [pages[f"http://h/{u}"].depth for u in ("a", "b", "c.docx", "d")] == [0, 1, 1, 2] and "http://h/e" not in pages
    assert (pages["http://h/b"].frontier_title, pages["http://h/b"].snippet, pages["http://h/b"].crawl_source) == ("faq one", "discovered from http://h/a", "site_discovery")
    documents = {r.url: r for r in got.documents.collect()}
    assert set(documents) == {"http://h/b", "http://h/c.docx", "http://h/d", "http://h/twin"}
    # pages without a title take the link's; office files are named after their address
    assert documents["http://h/b"].title == "faq one" and documents["http://h/c.docx"].title == "c.docx"
    assert (documents["http://h/c.docx"].content_type, documents["http://h/c.docx"].crawl_depth, documents["http://h/twin"].crawl_source) == ("docx", 1, "search")
    log = {(r.url, r.reason): r for r in got.failures.collect()}
    assert set(log) == {
        ("http://h/a", "ai_content_irrelevant"), ("http://h/s", "content_too_short"), ("http://h/bad.docx", "docx_parse_failed"), ("http://h/bad.docx", "content_too_short"),
        ("http://h/x.bin", "unsupported_content_type"), ("http://h/gone", "fetch_failed"), ("http://h/f.x", "pdf_parse_failed"), ("http://h/f.x", "content_too_short"),
    }
    assert log["http://h/gone", "fetch_failed"].error == "timeout" and log["http://h/x.bin", "unsupported_content_type"].content_type == "application/octet-stream"
    assert log["http://h/s", "content_too_short"].title == "a hit" and log["http://h/a", "ai_content_irrelevant"].reason_detail == "no"
    assert sorted(r.source_url for r in got.records.collect()) == sorted(documents)
    s = got.summary.first()
    assert (s.useful, s.new_qa, s.discovered) == (4, 4, 10)


def test_crawl_passes_over_history(spark):
    seeds = spark.createDataFrame([(0, "http://h/a"), (1, "http://h/d")], "ord long, url string")
    history = {"urls": spark.createDataFrame([("http://h/a",)], "url string"), "failures": spark.createDataFrame([("http://h/e", "fetch_failed")], "url string, reason string")}
    got = plan.run(plan.frontier(seeds), _fetch, _reply, _pairs, (), Config(max_depth=1), history)
    assert [r.asked for r in got.pages.collect()] == ["http://h/d"] and not got.failures.count()
    none = plan.run(plan.frontier(seeds.where("false")), _fetch, _reply, _pairs)
    assert not none.pages.count() and not none.documents.count() and not none.failures.count()


def test_key_store(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "h string")
    keys = lambda s: sorted(r.h for r in s.keys().collect())
    store = KeyStore(spark, f"file://{tmp_path}/keys", "h", buckets=4)
    store.add(rows("a", "b", "a", None), "r1")
    store.add(rows("b", "c"), "r2")
    store.add(rows("b", "c", "d"), "r2")  # the run again
    assert keys(store) == ["a", "b", "c", "d"]
    again = KeyStore(spark, f"file://{tmp_path}/keys", "h", buckets=4)
    assert keys(again) == ["a", "b", "c", "d"] and sorted(r.h for r in again.new(rows("a", "x", "x", None)).collect()) == ["x", "x"]
    assert sorted(r.h for r in again.new(rows("a", "c"), "r2").collect()) == ["c"]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # one exchange, that of the new rows
        text = again.new(rows("a", "x"))._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Bucketed: true" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    again.compact("all")
    assert keys(again) == ["a", "b", "c", "d"] and [x for x in os.listdir(f"{tmp_path}/keys") if x.startswith("run=")] == ["run=all"]
    again.compact("all")
    assert keys(KeyStore(spark, f"file://{tmp_path}/keys", "h", buckets=4)) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("cuts", [[], [30], [7, 8, 40], [1, 2, 3, 59]])
def test_judged_stream_in_any_split(spark, tmp_path, cuts):
    r = random.Random(1)
    rows = [(i, r.choice(["p", "q", "r", "s", None]), r.choice([True, False, None]), f"page {i}") for i in range(60)]
    schema = "ord long, h string, useful boolean, title string"
    want = {x.ord: x.status for x in dedup.accepted_first(spark.createDataFrame(rows, schema), "h", "ord", F.col("useful")).collect()}
    store = KeyStore(spark, f"file://{tmp_path}/keys", "h", buckets=2)
    out = f"file://{tmp_path}/out"
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        batch = spark.createDataFrame(rows[a:b], schema)
        if k == 1:  # breaks off after its rows were written, then comes again
            with pytest.MonkeyPatch.context() as m:
                m.setattr(store, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    judged.judge_batch(batch, k, store, out)
        judged.judge_batch(batch, k, store, out)
        if k == 2:
            judged.judge_batch(batch, k, store, out)
    got = spark.read.parquet(out).collect()
    assert len(got) == 60 and {x.ord: x.status for x in got} == want and all(x.title == f"page {x.ord}" for x in got)


def test_append_of_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    for batch, part in ((0, rows), (1, rows), (1, rows.where("n = 2"))):
        judged.append(part, batch, f"{tmp_path}/log")
    assert sorted((x.n, x.batch) for x in spark.read.json(f"{tmp_path}/log").collect()) == [(1, judged.run_name(0)), (2, judged.run_name(0)), (2, judged.run_name(1))]


def test_lines_over_many_splits(spark, tmp_path):
    for name, n in (("b.jsonl", 700), ("a.jsonl", 900), ("c.jsonl", 0)):
        (tmp_path / name).write_text("".join(f'{{"n": {i}}}\n' for i in range(n)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = jsonl.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r.ord, r.value) for r in rows.collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == list(enumerate([f'{{"n": {i}}}' for i in range(900)] + [f'{{"n": {i}}}' for i in range(700)]))
    assert jsonl.lines(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("block", [keywords.BLOCK_CHARS, 7])
def test_keyword_tables(spark, block):
    words = ["ab", "b", "abc", "Fluß", "校园", "", None, "b", "zz"]
    texts = ["", None, "ABC", "xbx", "FLUß und 校园卡", "zzz ab", "nothing"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.w for r in rows.withColumn("w", keywords.contained(table, "word", F.col("t"), block)).collect()}
    lower = {w.lower() for w in words if w}
    assert got == {k: sorted(w for w in lower if w in (t or "").lower()) for k, t in enumerate(texts)}
    links = spark.createDataFrame([("http://h/zz", ""), ("http://h/x", "None"), ("http://h/zz.jpg", ""), ("http://h/list", "")], "u string, a string")
    useful = links.withColumn("ok", keywords.useful_link(F.col("u"), F.col("a"), F.lit(""), table.where("word = 'zz'"))).collect()
    assert [r.ok for r in useful] == [True, False, False, True]
    assert rows.withColumn("w", keywords.contained(table.where("false"), "word", F.col("t"))).where("size(w) > 0").count() == 0


def test_content_route_of_other_pdf_types(spark):
    rows = spark.createDataFrame([("http://h/a.b", "application/x-pdf")], "u string, t string")
    assert rows.select(urls.content_route(F.col("u"), F.col("t")).alias("r"), urls.content_route(F.col("u"), F.col("t"), False).alias("b")).first() == ("pdf", None)


def test_pruned_search_equals_the_scan(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 4
    points = np.concatenate([c + r.normal(size=(60, 16)) * 0.3 for c in centres] + [centres[:1].repeat(5, 0)])
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(9999, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = items.where("vec_id % 97 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path = f"file://{tmp_path}/cells"
    retrieval.build_cells(items, path, 24)
    opened = collections.Counter()
    best = retrieval._best
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "_best", lambda df, *a: (opened.update(x[0] for x in df.select(F.input_file_name()).distinct().collect()), best(df, *a))[1])
        got = retrieval.knn_cells(spark, path, asked, 10)
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(got) == key(retrieval.knn_topk_batch(items, asked, 10))
    every = spark.read.parquet(f"{path}/items").inputFiles()
    assert max(opened.values()) == 1 and 0 < len(opened) < 0.8 * len(every)
    assert key(retrieval.knn_cells(spark, path, asked.limit(1), 800)) == key(retrieval.knn_topk_batch(items, asked.limit(1), 800))
    assert retrieval.knn_cells(spark, path, asked.where("false")).count() == 0
    with pytest.raises(ValueError):
        retrieval.build_cells(items.where("false"), path)


def _counter(folder):
    """Writes down each call, in workers too."""

    def count(text):
        with open(f"{folder}/{os.getpid()}-{random.random()}", "w") as f:
            f.write(text)

    return count


def _asked(folder):
    return collections.Counter((folder / x).read_text() for x in os.listdir(folder))


def test_replies_are_asked_for_once(spark, tmp_path):
    calls, flag, store = tmp_path / "calls", tmp_path / "lost", f"file://{tmp_path}/store"
    calls.mkdir()
    flag.touch()
    count = _counter(calls)

    def complete(prompt):
        if prompt == "p7" and os.path.exists(flag):
            raise SystemExit("lost")  # takes the worker with it
        count(prompt)
        if prompt == "bad":
            raise ValueError("service")
        return f'{{"of": "{prompt}"}}'

    prompts = spark.createDataFrame([(str(i), f"p{i % 12}") for i in range(40)] + [("x", "bad")], "id string, prompt string")
    run = lambda: {r.id: r.reply for r in connectors.ask_once(prompts, complete, store, 0, lambda _: None, 1).collect()}
    with pytest.raises(Exception):
        run()
    first = _asked(calls)
    assert "p7" not in first and max(first.values(), default=1) == 1
    wave = {r.prompt: r.w for r in prompts.select("prompt", F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(13)).alias("w")).distinct().collect()}
    flag.unlink()
    got = run()
    assert got == {**{str(i): f'{{"of": "p{i % 12}"}}' for i in range(40)}, "x": "{}"}
    again = _asked(calls)
    # only the wave that broke off is asked again
    assert set(again) - {"bad"} == {f"p{i}" for i in range(12)} and all(n == 1 or wave[p] == wave["p7"] and n == 2 for p, n in again.items() if p != "bad")
    assert run() == got and _asked(calls) - again == collections.Counter({"bad": 1})
    assert connectors.ask_once(prompts.where("false"), complete, store).count() == 0


def test_batches_of_services(spark, tmp_path):
    """Batches are of the settings' size and of like lengths; results keep their rows."""
    seen = tmp_path / "seen"
    seen.mkdir()
    count = _counter(seen)

    def load():
        def encode(texts):
            count("e" + ",".join(str(len(t)) for t in texts))
            return [np.array([len(t), 1.0], np.float32) for t in texts]

        return encode

    def many(pairs):
        count(f"s{len(pairs)}")
        return [len(t) for _, t in pairs]

    config = Config(embed_batch=3, rerank_batch=4, max_tokens=2)
    embed, score = connectors.services(config, load, "test-batches", many)
    rows = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((1, 9, 2, 1, 0, 7, 2))] + [(7, None)], "k long, t string").coalesce(1)
    got = {r.k: r for r in rows.select("k", "t", embed("t").alias("v"), score(F.lit("q"), F.col("t")).alias("s")).collect()}
    assert all(r.v[0] == (len("word word") if (r.t or "").count("word") > 2 else len(r.t or "")) and r.s == len(r.t or "") for r in got.values())
    calls = _asked(seen)
    assert calls["s4"] == 2 and sum(n for c, n in calls.items() if c[0] == "e") == 3
    for c in calls:
        if c[0] == "e":
            sizes = [int(x) for x in c[1:].split(",")]
            assert len(sizes) <= 3 and sizes == sorted(sizes, reverse=True)
    with pytest.raises(ValueError):
        connectors.by_length(lambda x: x[:-1], [1, 2], 2, lambda _: 0)


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("TOP_K", "7")
    monkeypatch.setenv("USE_RERANKER", "0")
    assert (Config.load().top_k, Config.load().use_reranker, Config.load().rerank_top_n) == (7, False, 5)
    spark.conf.set("kbforge.top_k", "9")
    try:
        assert Config.load(spark).top_k == 9 and Config.load(spark).query_task == Config().query_task
    finally:
        spark.conf.unset("kbforge.top_k")


def test_url_norm_equals_the_parser(spark):
    r = random.Random(6)
    bits = ["http://", "HTTPS://", "ftp:", "//", "A.com", "b.example:80", "u@h", "/", "/x", "/Y/", "//", ";p=1", "?", "a=1", "&", "utm_source=z", "From=1", "spm=", "q=a%20b", "q=校", "=", "#f/", "#", " ", "\\", "b", "%41", "[::1]", ".", "+", "é", "\t"]
    seen = ["", "http://a.com", "http://a.com/", "http://A.com/x/?UTM_x=1&b=2#t", "http://a.com/?", "http://a.com/?a", "http://a.com/x//", "http://a.com//", "mailto:a@b", "http://a.com/?a=b&&c=d", "x/y/", "http://a.com/a;b/c;d?x=1"]
    while len(seen) < 6000:
        url = "".join(r.choice(bits) for _ in range(r.randint(1, 9)))
        try:
            urls.normal_url(url)
        except ValueError:  # what the parser refuses
            continue
        seen.append(url)
    rows = spark.createDataFrame([(u,) for u in seen] + [(None,)], "u string")
    for u, n in rows.select("u", urls.url_norm(F.col("u"))).collect():
        assert n == urls.normal_url(u), u
