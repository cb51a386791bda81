"""Decontamination, lexical search and the Merkle manifest against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kbforge.llm import decontamination as dec
from kbforge.llm import lexical_search as lex
from kbforge.llm import merkle, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UP = {v: k for k, v in LOW.items()}


def words(t):
    return TERM.findall((t or "").translate(LOW))


def babble(r, n, size=12):
    return " ".join("abcdefghijklmnopqrstuvwxyz"[min(int(r.expovariate(0.4)), size - 1)] for _ in range(n))


R = random.Random(5)
LONG = "Die Prüfung No 42: wie heißt, DER Fluß; der durch_die Stadt fließt? Antwort: 日本 der Main und sonst keiner weit und breit."
ITEMS = [
    (1, babble(R, 25)), (2, LONG), (3, "Alpha-beta gamma"), (4, "solo"), (5, None), (6, " -- "), (7, babble(R, 10)), (2, "zweite Fassung von zwei mit mehr als zehn Wörtern die hier alle stehen"),
    (None, "nameless item words one two three four five six seven eight"), (8, babble(R, 400)), (10, LONG),
]
TEXTS = [
    None, "", " ,;\n ", "Alpha beta\nGAMMA delta", f"vorweg {LONG} danach", LONG.translate(UP), babble(R, 3000), "solo", "solo " * 30, ITEMS[0][1] + " " + ITEMS[6][1], "nameless item words one two three four five six seven eight",
    " ".join(words(LONG)[3:12]), "x " + " ".join(words(LONG)[3:13]) + " y", "naïve 😀 solo\x00tail", "Alpha BETA", ITEMS[9][1][100:400], "zweite Fassung von zwei mit mehr als zehn Wörtern die hier alle stehen",
] + [babble(R, 60) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "x", 1, "r") for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], "s1", "x", 1, "r"), (None, TEXTS[4], None, None, None, None), (4, "another text of that id", "s1", "x", 1, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, root string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int")


def hits(t):
    """Words hit and item_ids, window by window."""
    w, covered, found = words(t), set(), set()
    for item, text in ITEMS:
        iw = words(text)
        k = min(len(iw), 10)
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                covered |= set(range(i, i + k))
                found |= {item} - {None}
    return len(w), covered, found


def test_terms():
    got = [[x.decode() for x in t.values.slice(a, b - a).to_pylist()] for lo, hi, _, _, t in terms.slices(pa.array(TEXTS), limit=500) for a, b in zip(t.first, t.first[1:])]
    assert got == [words(t) for t in TEXTS]


@pytest.mark.parametrize("block", [dec.BLOCK_WORDS, 60])
def test_decontamination(spark, docs, items, block):
    got = dec.marked(docs.select("doc_id", "text", "root"), items, block_words=block)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "root", "_marks"] and len(rows) == len(TEXTS) + 3
    for r in rows:
        n, covered, found = hits(r.text)
        m = r._marks
        assert (m.n_words, m.n_hit, set(m.item_ids)) == (n, len(covered), {str(i) for i in found}), (r.text, m)
        assert {j for s in m.spans for j in range(s.start, s.end)} == covered
        assert (m.kept_text is None) == (not covered) and (not covered or words(m.kept_text) == [w for j, w in enumerate(words(r.text)) if j not in covered])
        if r.doc_id == 5:
            assert max(s.longest for s in m.spans) == len(words(LONG))


def test_op11(spark, docs, items):
    got = collections.defaultdict(list)
    for r in dec.op11(docs, items).collect():
        got[r.doc_id].append(r)
    assert len(got[4]) == 3 and len(got[None]) == 1
    for i, t in enumerate(TEXTS):
        n, covered, found = hits(t)
        names = ",".join(sorted(map(str, found)))
        want = (n, len(covered), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(covered))
        assert want in [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got[i]], i
    assert dec.op11(docs.where("false"), items).count() == 0
    assert not dec.op11(docs, items.where("false")).where("contaminated").count()
    left = dec.decontaminated(docs, items)
    assert left.columns == docs.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert 5 not in kept and 7 not in kept and kept[14] == "Alpha BETA" and kept[1] == "" and kept[0] is None and kept[13] == "naïve 😀 tail"


def test_automaton_lengths():
    """Longest matches by brute force, items of any length, windows of 4."""
    r = random.Random(3)
    for _ in range(60):
        own = [(k, [bytes([97 + r.randrange(3)]) for _ in range(r.randint(1, 14))]) for k in range(r.randint(1, 6))]
        a = dec.Automaton(own, 4)
        text = [bytes([97 + r.randrange(3)]) for _ in range(60)]
        if any(w not in a.vocabulary for w in text):
            text = [w for w in text if w in a.vocabulary]
        spans, found = [], set()
        a.walk([a.vocabulary[w] for w in text], 0, spans, found)
        covered, items_hit = set(), set()
        for k, ws in own:
            n = min(4, len(ws))
            wins = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
            for i in range(len(text) - n + 1):
                if tuple(text[i : i + n]) in wins:
                    covered |= set(range(i, i + n))
                    items_hit.add(k)
        assert {j for s, e, _ in dec._merged(spans) for j in range(s, e)} == covered and found == items_hit
        grams = {tuple(ws[i:j]) for _, ws in own for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)}
        longest = max((j - i for i in range(len(text)) for j in range(i + 1, min(i + 15, len(text) + 1)) if tuple(text[i:j]) in grams), default=0)
        assert max((x for _, _, x in spans), default=0) == longest or longest < 4


def ranking(rows, queries, top):
    tf = [(i, collections.Counter(words(t))) for i, t in rows if words(t)]
    n_all, l_all = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(w for _, c in tf for w in c)
    out = {}
    for item, own in queries.items():
        scored = []
        for i, c in tf:
            m = 50 + 50 * sum(c.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in own if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out[item] = [(i, -s) for s, _, _, i in sorted(scored)[:top]]
    return out


@pytest.mark.parametrize("shard,block,top", [(lex.SHARD_BYTES, lex.BLOCK_TERMS, 50), (300, 20, 3), (2000, 1, 7)])
def test_lexical_search(spark, docs, items, shard, block, top):
    queries = collections.defaultdict(set)
    for i, t in ITEMS:
        queries[i] |= set(words(t))
    want = ranking([(r.doc_id, r.text) for r in docs.collect()], {i: q for i, q in queries.items() if q}, top)
    built = lex.written(lex.index(docs, shard_bytes=shard), "test-index")
    got = collections.defaultdict(list)
    for r in sorted(lex.search(built, items, top=top, block_terms=block).collect(), key=lambda r: r["rank"]):
        got[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert dict(got) == {i: x for i, x in want.items() if x}


def test_lexical_search_prunes_exactly(spark):
    """Many shards in one task, ties of equal texts, common and rare terms."""
    r = random.Random(11)
    rows = [(i, babble(r, r.randint(1, 80), 20)) for i in range(600)] + [(i, "b a c") for i in range(1000, 1100)]
    r.shuffle(rows)
    queries = {k: set(words(babble(r, 12, 26))) for k in range(20)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    built = lex.written(lex.index(docs, shard_bytes=900), "test-index")
    assert built.count() > 20
    items = spark.createDataFrame([(k, " ".join(q)) for k, q in queries.items()], "item_id long, text string")
    got = collections.defaultdict(list)
    for x in sorted(lex.search(built, items, top=10).collect(), key=lambda x: x["rank"]):
        got[x.item_id].append((x.doc_id, x.score))
    assert dict(got) == ranking(rows, queries, 10)


def test_lexical_search_without_rows(docs, items):
    assert lex.op12(docs.where("false"), items).count() == 0 and lex.op12(docs, items.where("false")).count() == 0
    assert lex.op12(docs.where("doc_id < 3"), items).count() == 0


def test_packed_integers():
    v = np.concatenate([np.arange(300), 2 ** np.arange(62), 2 ** np.arange(1, 62) - 1]).astype(np.int64)
    raw, sizes = lex.packed(v)
    assert lex.unpacked(raw).tolist() == v.tolist() and sizes.sum() == len(raw)
    assert lex.unpacked(lex.packed(np.zeros(0, np.int64))[0]).tolist() == []


H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def tree(hashes, fanout):
    """Root, and for each leaf its siblings of each level as (left, right)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0] if level else None, paths


def manifest(rows, fanout=16):
    """By doc_id order: tuples as op13 returns them."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, low=False: H(field(r.doc_id), field(r.source), field(r.lang), field(r.n_chars), field(r.text.translate(LOW) if low and r.text is not None else r.text))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[s]], fanout) for s in names]
    root, tops = tree([t[0] for t in trees], fanout)
    out = []
    for s, (sub, paths), top in zip(names, trees, tops):
        for r, path in zip(groups[s], paths):
            way = path + top
            at = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            for left, right in way:
                at = H(left, at, right)
            out.append((r.doc_id, leaf(r), sub, root, H(*[a + b for a, b in way]), at, at == root))
    return sorted(map(str, out))


def test_merkle_manifest(spark, docs):
    got = sorted(str(tuple(r)) for r in merkle.op13(docs).collect())
    assert got == manifest(docs.collect())
    assert merkle.op13(docs.where("false")).count() == 0
    one = docs.where("doc_id = 8")
    r = merkle.op13(one).first()
    assert r.subroot == r.root == r.leaf and r.proof_sha256 == H("")


@pytest.mark.parametrize("n,groups", [(17, 1), (256, 1), (257, 2), (700, 40), (60, 60)])
def test_merkle_levels(spark, n, groups):
    r = random.Random(n)
    rows = [(i if i % 9 else 7, f"g{r.randrange(groups) if i % 3 else 0}" if i % 11 else None, None, i, f"Text {i}" if i % 9 else "same") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.op13(docs)
    assert sorted(str(tuple(x)) for x in got.collect()) == manifest(docs.collect())


def test_merkle_fanout_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x")] * 40 + [(2, "a", "y")], "doc_id long, source string, text string")
    rows = merkle.manifest(docs, merkle.leaf([merkle.F.col("doc_id"), merkle.F.col("text")]), fanout=3).collect()
    hashes = [H("1:1", "1:x")] * 40 + [H("1:2", "1:y")]
    root, paths = tree(hashes, 3)
    assert {r.root for r in rows} == {root} and sorted(str([tuple(x) for x in r.path]) for r in rows) == sorted(map(str, paths))
    with pytest.raises(ValueError):
        merkle.manifest(docs, merkle.leaf([merkle.F.col("doc_id")]), fanout=1)
