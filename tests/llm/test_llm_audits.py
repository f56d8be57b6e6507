"""Filter interactions, substring dedup and source divergence against plain versions, with their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.llm import divergence, interactions, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, words string, rid long, term string, block int"
WORDS = r"[^\x20\x09-\x0D]+"


def docs(spark, rows):
    """Documents of (id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 9, "y", 3) for r in rows], SCHEMA)


def words(n, seed, of="abcdefghij", length=5):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(of), length)) for _ in range(n)]


# --- 11 filter interactions ---


def test_swaps_visit_every_order_once():
    for k in range(1, 7):
        order, seen = list(range(k)), [tuple(range(k))]
        for i in interactions.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(k))))


def plain_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q == 1, t == 1)[w]} for w in (0, 1))
    parts = defaultdict(list)
    for i, text, _, source in rows:
        text = text or ""
        w = re.findall(WORDS, text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        parts[source or ""].append((i, {f for f, v in fails.items() if v}))
    out = []
    for part, own in parts.items():
        shapley, found = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(removed)
                found.append((f, (part, "".join(order), step, len(left), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in own), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed))))
                gone += removed
        out += [(*r, shapley[f]) for f, r in found]
    return sorted(out)


def test_interactions_match_plain_walk(spark):
    long = " ".join(words(300, 1))
    rows = [(1, long, "en", "a"), (2, long, "en", "a"), (2, long, "en", "a"), (2, "Other $ text", "en", "a"), (None, long, "en", "b"), (None, None, None, None), (3, None, "en", ""), (4, "", "fr", None), (5, "A" * 300_000, "en", "b"), (6, "word " * 50_000, "en", "a"), (7, "ÄÖ É " * 250, "de", "b"), (8, "word " * 50_000, "en", "c"), (0, "Other $ text", "en", "c"), (9, "X&Y " + long, "en", "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1), (8, 1, 1)]
    table = spark.createDataFrame([(*x, 5, "z") for x in labels], "doc_id long, quality int, toxic int, mask int, part string")
    got = interactions.audit(docs(spark, rows), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert interactions.audit(docs(spark, rows).limit(0), table).count() == 0
    assert sorted(map(tuple, interactions.audit(docs(spark, rows), table.limit(0)).collect())) == plain_audit(rows, [])


def test_interactions_of_other_filters(spark):
    rows = docs(spark, [(i, "x" * i, "en", "s") for i in range(10)])
    few = interactions.audit(rows, rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), names="PQ", repeat=None, filters=lambda text, words: {"P": F.length(text) < 3, "Q": F.length(text) % 2 == 0})
    assert sorted((r.filter_order, r.step, r.removed, r.kept) for r in few.collect()) == [("PQ", 1, 3, 7), ("PQ", 2, 3, 4), ("QP", 1, 5, 5), ("QP", 2, 1, 4)]
    with pytest.raises(ValueError):
        interactions.walked(rows, "ABCDEFGHI")


# --- 12 substring dedup ---


def plain_dedup(rows, window=50):
    split = [re.findall(WORDS, r[1] or "") for r in rows]
    first = {}
    for (i, *_), w in zip(rows, split):
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if first[tuple(w[a : a + window])] < i:
                    gone |= set(range(a, a + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def hard_texts():
    """Shared passages of all lengths about a window, at all offsets; runs, periods, near copies, one word."""
    rng = np.random.default_rng(5)
    base, rows = words(400, 2), []
    rows.append(" ".join(base))
    for n in (48, 49, 50, 51, 55, 99, 100, 101, 160):
        at = int(rng.integers(0, 400 - n))
        rows.append(" ".join(words(int(rng.integers(0, 60)), 100 + n) + base[at : at + n] + words(int(rng.integers(0, 60)), 200 + n)))
    near = list(base)
    for k in range(30, 400, 61):
        near[k] = "changed"
    rows += [" ".join(near), " ".join(base[:200] + ["in"] + base[200:]), " ".join(base), "  \n".join(base) + " "]
    rows += ["word " * 120, "word " * 49, "word " * 50, "pre " + "word " * 70 + "post", "a b " * 60, "b a " * 40 + "c", "a a b " * 40, " ".join(["x"] * 60 + base[:60] + ["x"] * 60), "x " * 200]
    rows += [" ".join(rng.choice(["a", "b"], 300)) for _ in range(4)]
    rows += [" ".join(["k"] * int(n) + ["l"] * int(m)) for n, m in rng.integers(20, 70, (6, 2))]
    return rows


def test_substrings_match_brute_force(spark):
    texts = hard_texts()
    rng = np.random.default_rng(9)
    order = rng.permutation(len(texts)).tolist()
    rows = [(o * 10, t, "en", "s") for o, t in zip(order, texts)]
    base = texts[0]
    rows += [(None, base, "en", "s"), (None, base, "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, "é ü " * 30, "en", "s"), (6, "ü é " * 40, "en", "s"), (rows[2][0], rows[3][1], "en", "s"), rows[3], rows[3], (7, "  \t\n ", "en", "s")]
    want = plain_dedup(rows)
    for params in ({}, {"piece": 64}):
        got = substrings.report(docs(spark, rows), **params)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(map(tuple, got.collect()), key=key) == sorted((r[:4] for r in want), key=key)
    assert substrings.report(docs(spark, rows).limit(0)).count() == 0
    out = substrings.deduplicated(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    texts_of = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts_of == Counter((r[0], r[1] if not w[2] else w[4]) for r, w in zip(rows, want))


@pytest.mark.parametrize("window", [8, 50])
def test_equal_windows_have_equal_signs(window):
    """A window's sign doesn't depend on what is around it, whatever the window's words are."""
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 3, 20, 5000):
        own = rng.integers(1, kinds + 1, 3 * window).astype(np.uint64)
        names = substrings.mixed(own) | np.uint64(1)
        around = lambda n: substrings.mixed(rng.integers(1, kinds + 2, n).astype(np.uint64)) | np.uint64(1)  # noqa: E731,B023
        zero = np.zeros(1, np.uint64)
        alone = substrings.signs(np.r_[zero, names, zero], window)[1 : 2 * window + 2]
        for _ in range(20):
            a, b = around(int(rng.integers(0, 80))), around(int(rng.integers(0, 80)))
            got = substrings.signs(np.r_[zero, a, names, b, zero], window)
            assert np.array_equal(got[1 + len(a) : 1 + len(a) + 2 * window + 1], alone)


def test_long_text_is_cut_into_pieces_without_effect(spark):
    long = words(20_000, 4, "abc", 2)
    rows = [(1, " ".join(words(30, 8) + long[7_000:7_100]), "en", "s"), (2, " ".join(long), "en", "s"), (3, " ".join(long[9_950:10_050]), "en", "s")]
    want = sorted(r[:4] for r in plain_dedup(rows))
    assert want[1][2] >= 100 and want[2][2] == 100
    assert sorted(map(tuple, substrings.report(docs(spark, rows), piece=1000).collect())) == want


# --- 13 source divergence ---


def plain_divergence(rows, min_docs=10, top=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {f[0] for f in found}:
        seen, counts = Counter(), defaultdict(Counter)
        for g, source, terms in found:
            if g == lang:
                seen.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in seen.items() if n >= min_docs]
        total = Counter({t: sum(c[t] for c in counts.values()) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-apart(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, k) for part, own in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(own, 1)]
    return sorted(out)


def test_divergence_matches_plain_sums(spark):
    rng = np.random.default_rng(6)
    common = words(60, 3, "abcdé", 2)
    rows = [(i, " ".join(rng.choice(common, 40)) + " A-b It's 3x\x00y", ["en", "fr", None][i % 3], f"src{i % 11}") for i in range(200)]
    rows += [(None, None, None, None), (1, "", "en", ""), (1, "word " * 30_000, "de", "only"), (2, "alone text", "it", "s1"), (3, None, "it", "s2"), (3, None, "it", "s2"), (4, "É é ß " * 3, "en", None)]
    rows += [(9, "same same", "es", s) for s in ("x", "y", "ä", "Z") for _ in range(6)]
    want = plain_divergence(rows)
    table = docs(spark, rows).repartition(5)
    for params in ({}, {"block": 2, "chunk": 4, "span": 2}):
        got = divergence.audit(table, **params)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(table.limit(0)).count() == 0
    few = divergence.counted(table, held=20).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs"))
    assert sorted(map(str, few.collect())) == sorted(map(str, divergence.counted(table).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([0, 1, 10**14, 8 * 10**15 - 2]), 9 * 10**15 - 1
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


# --- 6 url filters: long paths ---


def test_a_very_long_url_costs_its_length(spark):
    import time

    from citeweave.llm import url_filters

    rows = [(i, f"https://h{i % 7}.example.org/{'ab'[i % 2]}/c{i % 5}/p-{i}") for i in range(1000)]
    rules = [("block", "h1.example.org/a/")]

    def judged(own):
        began = time.time()
        got = {r.page_id: (r.verdict, r.template) for r in url_filters.judged(spark.createDataFrame(own, "page_id long, url string"), rules).collect()}
        return time.time() - began, got

    judged(rows)
    plain, want = judged(rows)
    long = "https://h1.example.org/" + "/".join(f"s{'xyz'[i % 3]}" for i in range(100_000))
    slow, got = judged([*rows, (1000, long)])
    assert got.pop(1000)[1].count("/") == 100_000 and got == want
    assert slow < 2 * plain + 20
