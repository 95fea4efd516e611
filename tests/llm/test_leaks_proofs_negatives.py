"""Winnowing, the Merkle manifest and hard negatives against plain Python, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import hard_negatives, merkle, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "w", "h", "at", "n", "tree", "payload", "digest", "window", "size", "start", "set", "_row", "_part", "key", "cls", "dim", "slot", "rank")


def clashing(df):
    return df.select("*", *[F.lit(0).alias(c) for c in CLASH])


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_leaks(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        if w:
            for i in range(max(1, len(w) - size + 1)):
                windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in range(1, size + 1):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks(spark, docs, items, **kw):
    d = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1)).withColumn("size", F.lit(1))
    rows = winnow.decontaminate(d, b, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def random_texts():
    rng = random.Random(5)
    say = lambda n, k: " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))  # few words: windows repeat and tie
    items = [(i, say(rng.randint(1, 24), 2 + i % 6)) for i in range(12)] + [(3, say(15, 5)), (None, say(12, 4)), (None, "zebra apple"), (50, None), (51, ""), (52, "?!")]
    items.append((99, " ".join(f"word{i}" for i in range(30))))
    docs = [(i, say(rng.randint(0, 60), 2 + i % 6)) for i in range(40)]
    docs += [(None, None), (None, "Zebra, APPLE zebra"), (7, ""), (8, "word1 Word2-word3 word4 word5 word6 word7 word8 word9 word10"), (8, "word1 word2 word3 word4 word5 word6 word7 word8 word9"), (9, "ÀB Köln 漢字 " + items[5][1]), (9, "ÀB Köln 漢字 " + items[5][1])]
    docs.append((10, "x " * 30000 + " ".join(f"word{i}" for i in range(30)) + " y" * 30000))
    return docs, items


@pytest.mark.parametrize("block", [10**6, 40])
def test_winnowing_equals_brute_force(spark, block):
    docs, items = random_texts()
    assert leaks(spark, docs, items, block=block) == brute_leaks(docs, items)


def test_winnowing_of_long_items_only(spark):
    docs, items = random_texts()
    items = [i for i in items if len(plain_words(i[1])) >= 10]
    assert leaks(spark, docs, items) == brute_leaks(docs, items)


def test_winnowing_of_nothing(spark):
    assert leaks(spark, [], [(1, "a b")]) == []
    assert leaks(spark, [(1, "a b"), (None, None)], []) == brute_leaks([(1, "a b"), (None, None)], [])
    with pytest.raises(ValueError):
        winnow.decontaminate(None, None, size=11)


def test_contaminated_documents_go(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, "clean text"), (None, passage), (None, "clean"), (4, None)], "doc_id long, text string")
    kept = winnow.without_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4"]


def test_the_main_path_of_winnowing_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = winnow.decontaminate(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=8):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def build(leaves):
        """Root, and for each leaf its steps."""
        paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for k, at in enumerate(where):
                run = at // arity * arity
                paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
                where[k] = at // arity
            level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        return level[0], paths

    def leaf(r, text):
        return H(*(enc(v) for v in (r[0], r[3], r[2], r[4], text)))

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((leaf(r, r[1]), r))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        built[lang] = build([x[0] for x in by[lang]])
    root, tops = build([built[v][0] for v in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        for (digest, r), path in zip(by[lang], built[lang][1]):
            steps = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            h = leaf(r, r[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if tampered else digest
            for pre, post in steps:
                h = H(pre, h, post)
            out.append((r[0], digest, built[lang][0], root, H(*(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, arity=8):
    found = merkle.documents_manifest(clashing(spark.createDataFrame(rows, SCHEMA)), arity).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found), key=str)


@pytest.mark.parametrize("arity", [8, 2, 3])
def test_manifest_equals_a_plain_tree(spark, arity):
    rows = [(i, f"Text Ä {i}" if i % 5 else None, ["en", "de", None, "é"][i % 4 if i < 40 else 0], "a" if i % 3 else None, i if i % 7 else None) for i in range(75)]
    rows += [(6, "again", "en", "a", 5), (6, "Again", "en", "a", 5), (6, "again", "en", "a", 5), (None, "no id", "en", "a", 0), (None, "", None, None, None), (500, "alone", "zz", "a", 1), (501, "", "", "", 0), (502, "LONG " * 50000, "en", "a", 1)]
    got = manifest_rows(spark, rows, arity)
    assert got == brute_manifest(rows, arity)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_small_manifests(spark):
    assert manifest_rows(spark, []) == []
    assert spark.createDataFrame([], SCHEMA).transform(merkle.documents_manifest).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    one = [(3, "Only one", "en", "a", 8)]
    assert manifest_rows(spark, one) == brute_manifest(one)
    nine = [(i, f"t{i}", "en", "a", 1) for i in range(9)]
    assert manifest_rows(spark, nine) == brute_manifest(nine)


def brute_negatives(rows, best=5, hard=5, least=80):
    rows = [(k, i, lab, np.floor(256 * np.array(v, np.float64))) for k, (i, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    rows = [(k, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, v) for k, i, lab, v in rows]
    out = []
    for ka, ia, la, va in rows:
        if ia is None or ia % 100:
            continue
        scored = sorted(((-int(va @ v), i is None, i or 0, k, lab) for k, i, lab, v in rows if k != ka and len(v) == len(va)))
        for ps, pn, pi, _, _ in [s for s in scored if s[4] == la][:best]:
            fit = [s for s in scored if s[4] != la and least * -ps <= 100 * -s[0] <= 100 * -ps][:hard]
            out += [(ia, None if pn else pi, n + 1, None if s[1] else s[2], -ps, -s[0]) for n, s in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return sorted((tuple(r) for r in hard_negatives.mined_embeddings(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    v = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))
    return [[float(x) for x in np.float32(r / np.linalg.norm(r))] for r in v]


@pytest.mark.parametrize("spread", [0.3, 2.0])
def test_negatives_equal_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = [(i * 4, v, i % 3) for i, v in enumerate(vectors(700, 20, spread, 3))]
    assert mined(spark, rows) == brute_negatives(rows)


def test_odd_vectors(spark):
    v = vectors(30, 6, 1.0, 9)
    rows = [(i, x, i % 2) for i, x in enumerate(v)] + [(100, v[0], 0), (100, v[1], 1), (200, v[0], 0), (None, v[0], 1), (None, v[0], 0), (300, [0.0] * 6, 0)]
    rows += [(400, None, 1), (500, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (600, [float("nan")] * 6, 1), (700, [], 0), (800, [1.0, 2.0], 0), (801, [2.0, 1.0], 0), (802, [2.0, 1.0], 1), (900, v[3], None), (1000, [-x for x in v[2]], 1), (1100, [float("inf")] * 6, 0)]
    rows += [(2000 + i, v[4], i % 3) for i in range(30)]  # ties
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_lists_leave_out_what_norms_cover():
    rng = np.random.default_rng(1)
    rows, anchors = np.floor(40 * rng.normal(size=(300, 24))), np.floor(40 * rng.normal(size=(9, 24)))
    whole = anchors @ rows.T
    for least in (np.full(9, 15000.0), np.full(9, 0.0), np.full(9, -np.inf), whole.max(axis=1)):
        i, j, s = hard_negatives.Lists(rows).reach(anchors, least)
        assert set(zip(i, j)) == set(zip(*np.nonzero(whole >= least[:, None]))) and (s == whole[i, j]).all()
