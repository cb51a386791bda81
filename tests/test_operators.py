"""Operators against sequential simulations written from the survey."""

import io
import itertools
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbforge.operators import chunk, crawl, dedup, qa, retrieval
from kbforge.functions import prompts
from kbforge.plans import ask
from kbforge.plans import crawl as plan
from kbforge.sources import connectors, html, office
from kbforge.streaming import dedup as stream


@pytest.mark.parametrize("size,least,want", [((2500, 300), 300, {0: [], 250: [], 300: [300], 2500: [2500], 2501: [2500, 301], 5000: [2500, 2500, 600]}), ((2200, 300), 250, {249: [], 250: [250], 2201: [2200, 301], 2501: [2200, 601], 5000: [2200, 2200, 1200]})])
def test_chunks(spark, size, least, want):
    rows = spark.createDataFrame([(n, "x" * n) for n in want], "k long, t string")
    got = chunk.chunks(rows, "k", "t", *size, least).orderBy("k", "chunk_id").collect()
    for n, lengths in want.items():
        own = [r for r in got if r.k == n]
        assert [len(r.chunk) for r in own] == lengths and [r.chunk_id for r in own] == list(range(1, len(own) + 1))
    with pytest.raises(ValueError):
        chunk.windows(F.col("t"), 5, 5)


def test_accepted_first_matches_the_loop(spark):
    cases, want = [], {}
    n = 0
    for size in (1, 2, 3):
        for keys in itertools.product("ab", repeat=size):
            for verdicts in itertools.product((True, False, None), repeat=size):
                for known in ("", "a"):
                    seen = {f"{n}a"} if known else set()
                    for i, (k, v) in enumerate(zip(keys, verdicts)):
                        key = f"{n}{k}"
                        if key in seen:
                            status = "duplicate_content"
                        elif v is True:
                            status = "kept"
                            seen.add(key)
                        else:
                            status = "ai_content_irrelevant"
                        cases.append((key, i, v, n, bool(known)))
                        want[n, i] = status
                    n += 1
    rows = spark.createDataFrame(cases, "h string, o int, v boolean, n int, known boolean")
    history = rows.where("known").select(F.concat(F.col("n").cast("string"), F.lit("a")).alias("h")).distinct()
    got = {(r.n, r.o): r.status for r in dedup.accepted_first(rows, "h", "o", F.col("v"), history).collect()}
    assert got == want


def test_keep_first_history_log_cap_union(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), (None, 5), (None, 4)], "k string, o int")
    assert sorted((r.k or "", r.o) for r in dedup.keep_first(rows, "k", "o").collect()) == [("", 4), ("a", 2), ("b", 1)]
    assert dedup.not_in_history(rows, rows.where("k = 'a'"), ["k"]).count() == 3
    log = spark.createDataFrame([("u", "r", 2), ("u", "r", 1), ("u", "s", 3), ("", "r", 4)], "url string, reason string, o int")
    assert sorted(r.o for r in dedup.failure_log(log, "o", spark.createDataFrame([("u", "s")], "url string, reason string")).collect()) == [1]
    hits = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "o int, ok boolean")
    assert dedup.page_cap(hits, "o", F.col("ok"), 3).count() == 7 and dedup.page_cap(hits, "o", F.col("ok"), 99).count() == 20
    a, b = (spark.createDataFrame(list(zip(x, range(9))), "v string, o int") for x in (["x", "y", "x"], ["y", "z", "z", "w"]))
    assert [r.v for r in dedup.ordered_union(a, b, "v", "o", 4).orderBy("ord").collect()] == ["x", "y", "x", "z"]


def web(spark, links, failing=()):
    table = spark.createDataFrame([(u, u not in failing, v if u not in failing else []) for u, v in links.items()], "url string, ok boolean, links array<string>")
    return lambda level: level.select("url").join(table, "url", "left").select("url", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("links", F.expr("CAST(array() AS array<string>)")).alias("links"))


def simulate(links, seeds, depth, pages, failing=(), history=()):
    queue, queued, out, ok = [(u, 0) for u in seeds], set(seeds), [], 0
    while queue and ok < pages:
        u, d = queue.pop(0)
        if u in history:
            continue
        good = u in links and u not in failing
        out.append((u, d))
        ok += good
        if good and d < depth:
            for v in links[u]:
                if v not in queued:
                    queued.add(v)
                    queue.append((v, d + 1))
    return out


@pytest.mark.parametrize("depth,pages,history", [(1, 9, ()), (2, 9, ()), (2, 3, ()), (2, 9, ("a",))])
def test_bfs(spark, depth, pages, history):
    links = {"s": ["a", "b", "f"], "a": ["b", "c"], "b": ["d", "s"], "c": [], "d": [], "f": ["z"]}
    seen = spark.createDataFrame([(h,) for h in history], "url string")
    got = crawl.bfs_crawl(spark.createDataFrame([("s", 0)], "url string, ord long"), web(spark, links, ("f",)), depth, pages, seen)
    assert [(r.url, r.depth) for r in got.orderBy("position").collect()] == simulate(links, ["s"], depth, pages, ("f",), history)


def test_vectors(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8)).astype(np.float32)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    unit = items.select("vec_id", retrieval.l2_normalize(F.col("embedding")).alias("e")).collect()
    assert all(abs(sum(x * x for x in row.e) - 1) < 1e-9 for row in unit)
    asked = items.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    exact = np.round(v[:5].astype(float) @ v.astype(float).T, 6)
    for k in (1, 7, 100):
        got = retrieval.knn_topk_batch(items, asked, k).collect()
        for q in range(5):
            mine = [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])]
            assert mine == np.lexsort((np.arange(60), -exact[q]))[:k].tolist()
    assert [x.vec_id for x in retrieval.knn_topk(items, v[0].tolist(), 3).orderBy("rank").collect()] == np.lexsort((np.arange(60), -exact[0]))[:3].tolist()


def _peak(f) -> int:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_vector_search_holds_few_products():
    """Memory of a task follows neither the number of queries times a batch's items, nor that of items times cells."""
    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, (9000, 8)).astype(np.float64), rng.integers(-2, 3, (3000, 8)).astype(np.float64)
    v[5000:5400] = v[0]  # many ties
    keys = rng.permutation(len(v))
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(list(v[a:b]))], ["k", "v"]) for a, b in ((0, 7), (7, 20), (20, 20), (20, 9000))]
    found = []
    given = batches()
    assert _peak(lambda: found.extend(retrieval._scan(iter(given), q, 30))) < 100_000_000  # 3,000 x 4,096 products alone are 98 MB
    scores, ids = np.concatenate([s for _, s, _ in found]), np.concatenate([k for _, _, k in found])
    assert [at for at, _, _ in found] == list(range(0, 3000, 256))
    for i in range(0, 3000, 61):
        s = np.round(q[i] @ v.T, 6)
        best = np.lexsort((keys, -s))[:30]
        assert (ids[i] == keys[best]).all() and (scores[i] == s[best]).all()
    centres = rng.normal(size=(2000, 8))
    near = []
    assert _peak(lambda: near.append(retrieval._nearest(v, centres))) < 60_000_000  # 9,000 x 2,000 products alone are 144 MB
    assert (near[0][::97] == [np.argmin(((x - centres) ** 2).sum(1)) for x in v[::97]]).all()


def test_pooling(spark):
    rows = spark.createDataFrame([([[1.0], [2.0], [3.0]], [1, 1, 0], False), ([[1.0], [2.0], [3.0]], [0, 1, 1], True)], "s array<array<double>>, m array<int>, left boolean")
    assert [r[0] for r in rows.select(retrieval.last_token_pool(F.col("s"), F.col("m"), F.col("left"))).collect()] == [[2.0], [3.0]]


def test_rerank_keeps_ties_and_contexts(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10, s, f"q{i}", "a", "") for i, s in ((1, 0.5), (2, 0.9), (3, 0.5))], "query_id long, rank int, score double, rerank_score double, question string, answer string, index_text string")
    best = retrieval.rerank_topn(hits, 3)
    assert [(r["rank"], r.faiss_rank) for r in best.orderBy("rank").collect()] == [(1, 2), (2, 1), (3, 3)]
    text = retrieval.build_context(best).first().context
    assert text.startswith("[资料1 | FAISS相似度 0.8000 | Rerank分数 0.9000]\n问题：q2\n答案：a\n\n[资料2")
    assert retrieval.build_context(best, len(text)).first().context == text and retrieval.build_context(best, len(text) - 1).first().context == text[:-1] + retrieval.CUT_NOTICE
    plain = retrieval.topn_no_rerank(hits, 1).withColumns({"faiss_score": F.col("score"), "rerank_score": F.lit(None).cast("double"), "question": F.lit(""), "answer": F.lit(" "), "index_text": F.lit("i")})
    assert retrieval.build_context(plain).first().context == "[资料1 | 相似度 0.9000]\ni"


PAGE = """<html><head><title> A <b>t</b></title><script>x</p></script></head><body><nav><a href="/list/1">Nav</a></nav>
<div class="Main-Content"><p>First line of text<p>First line of text</p>ab<table><tr><td>k</td><td> v  w </td></tr><tr><td></td></tr></table>
<a href="b.pdf#x">doc &amp; more</a><a href="pic.jpg">no</a><a href="/list/1/">again</a></div><footer>foot</footer></body></html>"""


def test_html():
    title, content, links = html.extract(PAGE, "http://h.tld/a/")
    assert title.startswith("A") and links == [("http://h.tld/list/1", "Nav", "http://h.tld/a/"), ("http://h.tld/a/b.pdf", "doc & more", "http://h.tld/a/")]
    assert content.startswith("First line of text\n") and content.count("First line") == 1 and content.endswith("\n\n[表格内容]\nk | v w") and "foot" not in content and "\nab\n" not in content
    assert html.extract("<body><main>in main</main><article>art</article></body>", "u")[1] == "in main"
    assert html.extract('<div id="detail9">by id here</div>', "u")[1] == "by id here" and html.extract(None, "")[1] == ""
    assert html.extract_base("<body><p>short</p><p>long enough line</p></body>")[1] == "long enough line"
    assert len(html.extract("".join(f'<a href="/list/{i}">x</a>' for i in range(9)), "http://h/", (), 4)[2]) == 4


def office_file(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


W, S, R = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DOCX = {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}
XLSX = {
    "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="N" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>head</t></si></sst>', "xl/worksheets/s.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>',
}


def test_office(spark):
    rows = [("docx", "http://h/a.docx", office_file(DOCX)), ("xlsx", "http://h/", office_file(XLSX)), ("docx", "u", b"no"), ("zip", "u", b"")]
    got = spark.createDataFrame(rows, "kind string, url string, body binary").select(office.office_extract("kind", "url", "body").alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("a.docx", "One\na | b"), ("XLSX", "[工作表] N\nhead | 5"), (None, None), (None, None)]


def test_connectors(spark):
    tries = []

    def model(prompt):
        tries.append(prompt)
        if prompt == "bad":
            raise OSError
        return f'```json\n{{"p": "{prompt}"}}\n```'

    rows = spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, prompt string")
    assert {r.id: r.reply for r in connectors.ask_json(rows, model, wait=lambda s: None).collect()} == {"1": '{"p": "ok"}', "2": "{}"}
    got = {r.url: r.final_url for r in connectors.fetch(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: (u + "/", "text/html", b"x") if u == "a" else None).collect()}
    assert got == {"a": "a/", "b": None}


def test_state_and_records(spark):
    raw = spark.createDataFrame([("u", None, "a b"), ("u", "given", "c"), ("", None, "")], "url string, content_hash string, content string")
    q = spark.createDataFrame([("how?", None), ("how？", ""), ("x", "id1"), ("", "z")], "question string, id string")
    state = {k: v.count() for k, v in qa.load_state(raw, q).items()}
    assert state == {"urls": 1, "content_hashes": 2, "questions": 2}
    pairs = spark.createDataFrame([(" 1234 ", "12345"), (" 12345 ", "12345 ")], "question string, answer string")
    assert [tuple(r) for r in qa.qa_valid(pairs).collect()] == [("12345", "12345")]


def test_stream_equals_batch(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for part in (docs.where("doc_id < 120"), docs.where("doc_id >= 60")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_available(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/state")
    out = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(out) == sorted(r[0] for r in stream.hashed(docs).distinct().collect())


def test_ask(spark, tmp_path):
    items = spark.createDataFrame([(i, f"where is room {w}", f"in hall {w}", f"where is room {w}", "{}") for i, w in enumerate(("alpha", "beta", "gamma"))], "id long, question string, answer string, index_text string, raw string")
    embed = connectors.embedder()
    ask.build_index(items, f"{tmp_path}/ix", embed)
    meta = spark.read.json(f"{tmp_path}/ix/meta").first()
    assert (meta.num_items, meta.dimension) == (3, 64)
    index = ask.open_index(spark, f"{tmp_path}/ix")
    replies = ask.ask(index, spark.createDataFrame([(1, "where is room beta"), (2, " "), (3, "Quit"), (4, None)], "query_id long, question string"), embed, connectors.cross_scorer(), lambda messages, **options: "answer" if messages[0]["role"] == "system" else "no system rule").collect()
    assert len(replies) == 1 and replies[0].reply.startswith("answer\n\n---\n\n**参考资料 Top 3：**\n- [1] where is room beta\n")
    with pytest.raises(FileNotFoundError):
        ask.open_index(spark, f"{tmp_path}/none")


def test_generate_settings(spark):
    def chat(messages, **options):
        if "chat_template_kwargs" in options:
            raise ValueError("unknown field chat_template_kwargs")
        if messages[-1]["content"] == "bad":
            raise OSError("down")
        return f"{messages[0]['content']} {options['max_tokens']}"

    rows = spark.createDataFrame([("1", [("system", "rule"), ("user", "x")]), ("2", [("user", "bad")])], "id string, messages array<struct<role:string,content:string>>")
    got = {r.id: r.answer for r in connectors.generate(rows, chat).collect()}
    assert got["1"] == "rule 512" and "down" in got["2"]


def test_embedder_loads_once_and_cuts(spark, tmp_path):
    def load():
        open(f"{tmp_path}/{__import__('os').getpid()}-{__import__('uuid').uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t.split())), float(len(texts))] for t in texts]

    embed = connectors.embedder(load=load, name=str(tmp_path), batch=4, max_tokens=3)
    got = spark.range(10).coalesce(1).selectExpr("'a b c d e' AS t").select(embed("t").alias("v")).collect()
    assert all(r.v[0] == 3.0 for r in got) and [r.v[1] for r in got] == [4.0] * 8 + [2.0] * 2
    import os

    assert len({f.split("-")[0] for f in os.listdir(tmp_path)}) == len(os.listdir(tmp_path))


def test_keep_first_breaks_ties(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 2, "0"), (None, 3, "n")], "key string, ord long, x string")
    assert sorted((r.key or "", r.ord, r.x) for r in dedup.keep_first(rows, "key", "ord").collect()) == [("", 3, "n"), ("k", 1, "a")]
    log = spark.createDataFrame([("u", "r", 1, "b"), ("u", "r", 1, "a"), ("", "r", 0, "c")], "url string, reason string, ord long, x string")
    assert [tuple(r) for r in dedup.failure_log(log, "ord").collect()] == [("u", "r", 1, "a")]


def test_crawl_fetches_no_more_than_it_may_keep(spark):
    asked = []

    def fetch(level):
        asked.extend(r.url for r in level.collect())
        return level.select("url", (F.col("url") != "u1").alias("ok"), F.expr("CAST(array() AS array<string>)").alias("links"))

    got = crawl.bfs_crawl(spark.createDataFrame([(f"u{i}", i) for i in range(9)], "url string, ord long"), fetch, 1, 3).orderBy("position").collect()
    assert [r.url for r in got] == ["u0", "u1", "u2", "u3"] and sorted(asked) == ["u0", "u1", "u2", "u3"]


def test_pages_to_records(spark):
    long = "word " * 400
    rows = [
        (1, "HTTP://H.e/a/", " T ", "F", "short"), (2, "http://h.e/b", "", "Front", long), (3, "http://h.e/c", None, None, long), (4, "http://h.e/d", "D", None, "text " * 60), (5, "http://h.e/e", "E", None, None),
    ]
    pages = spark.createDataFrame(rows, "ord long, url string, title string, frontier_title string, content string")
    reply = F.when(F.col("ord") < 4, '{"useful": true, "category": "rules", "reason": "r"}').otherwise("not json")
    v = plan.verdict(reply)
    got = plan.judged(pages, v["useful"], v["category"], v["reason"])
    by = {r.ord: r for r in got.collect()}
    assert {k: r.status for k, r in by.items()} == {1: "content_too_short", 2: "kept", 3: "duplicate_content", 4: "ai_content_irrelevant", 5: "content_too_short"}
    assert (by[2].title, by[3].title, by[2].ai_category, by[4].ai_category) == ("Front", "http://h.e/c", "rules", "other")
    log = {r.ord: r for r in plan.failures(got).collect()}
    assert sorted(log) == [1, 3, 4, 5] and log[1].url == "http://h.e/a" and log[1].length == 5 and log[3].content_hash == by[2].content_hash
    docs = plan.raw_documents(got)
    pairs = '{"qa_pairs": [{"question": " How long? ", "answer": "Very long"}, {"question": "Why", "answer": "too short"}, "no object", {"question": "How  long?", "answer": "Second one", "category": "x"}]}'
    replies = plan.chunked(docs).select("ord", "chunk_id", F.when(F.col("chunk_id") == 1, pairs).otherwise('{"qa_pairs": 5}').alias("reply"))
    made = plan.synthesized(docs, replies).collect()
    assert [(r.question, r.answer, r.category, r.source_title, r.source_url, r.chunk_id) for r in made] == [("How long?", "Very long", "rules", "Front - chunk 1", "http://h.e/b", 1)]
    assert made[0].evidence == long.strip()[:250] and plan.synthesized(docs, replies, known=spark.createDataFrame([(made[0].id,)], "id string")).count() == 0
    assert qa.crawl_summary(got, records=spark.createDataFrame(made), discovered=pages).first().asDict() == {"pages": 5, "useful": 1, "skipped": 4, "new_qa": 1, "discovered": 5}


def test_routes_of_fetched_pages(spark):
    rows = [("http://a/x", "http://a/y.pdf", "application/pdf", b"1"), ("http://a/z.doc", None, "", b"1"), ("http://a/q", None, None, None)]
    got = {r.url: (r.route, r.failure) for r in plan.routed(spark.createDataFrame(rows, "url string, final_url string, content_type string, body binary")).collect()}
    assert got == {"http://a/y.pdf": ("pdf", None), "http://a/z.doc": ("unsupported_doc", "unsupported_doc"), "http://a/q": ("fetch_failed", "fetch_failed")}


def test_failure_keys(spark):
    rows = spark.createDataFrame([("HTTP://H/a/", "r"), ("http://h/a", "r"), ("", "r"), ("http://h/a", None)], "url string, reason string")
    assert [tuple(r) for r in qa.load_failures(rows).collect()] == [("http://h/a", "r")]


def test_prompts(spark):
    t = F.lit("t" * 5000)
    row = spark.range(1).select(prompts.keywords(F.lit("need")).alias("k"), prompts.content_judge(F.lit("need"), F.lit(None).cast("string"), F.lit("u"), t).alias("c"), prompts.qa_pairs(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("q"), prompts.url_judge(F.lit("n"), F.lit("u"), F.lit("t"), F.lit("s")).alias("u")).first()
    assert "at most 20" in row.k and row.c.count("t" * 3500) == 1 and "t" * 3501 not in row.c and '"qa_pairs"' in row.q and '"relevant"' in row.u


def test_search_web(spark):
    hits = spark.createDataFrame([("k", 0, "http://a.b/1"), ("k", 1, "http://z/2"), ("k", 2, ""), ("k", 3, "http://a.b/4"), ("other", 0, "http://a.b/5")], "keyword string, ord long, url string")
    got = connectors.search_web(spark.createDataFrame([("k",), ("none",)], "keyword string"), hits, 3, ("a.b",))
    assert [r.url for r in got.collect()] == ["http://a.b/1"]
