"""Filter audit, collocations and outlier rules against plain versions."""

import itertools
import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import LOWER, words
from transitloom.llm import collocations, filter_audit, outliers

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, h LONG, bits INT, n LONG, part STRING"


def _docs(spark, rows):
    """(doc_id, text, lang) with clashing extra columns."""
    return spark.createDataFrame([(i, t, g, "s", 7, 7, 7, "x") for i, t, g in rows], SCHEMA).repartition(4)


# ---- filter audit ----------------------------------------------------------------------------------


def _audit(rows, labels):
    fails, out = [], {}
    for i, text, lang in rows:
        t = text or ""
        own = [w.decode() for w in words(t)]
        bad = {
            "A": len(own) < 200, "B": 100 * len(set(own)) < 50 * len(own), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        marks = [m for m in labels if m[0] == i and i is not None]
        fails.append((lang or "", {k for k, v in bad.items() if v}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        removed = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                removed[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def _texts():
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(260))
    texts = [None, "", "", "Short ONE", "a $ b", long, long, long.upper(), "w " * 300, "w " * 300, long + " #1", " \n\t ", long]
    rows = [(i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, long, "en"), (None, long, "en"), (6, "another text", "en")]


def test_audit_matches_plain_version(spark):
    labels = [(5, 1, 0), (6, 1, 1), (12, 0, 1), (99, 1, 1), (3, None, None)]
    got = filter_audit.interaction_audit(_docs(spark, _texts()), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")).collect()
    want = _audit(_texts(), labels)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want) == 3 * 600


def test_audit_of_a_hot_group_and_of_nothing(spark):
    rows = [(i, "same text", "en") for i in range(3000)] + [(5000 + i, f"text {i}", "en") for i in range(30)]
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    got = filter_audit.interaction_audit(_docs(spark, rows), labels)
    first = got.where("filter_order = 'EABCD' AND step = 1").first()
    assert (first.removed, first.kept) == (2999, 31)
    assert filter_audit.interaction_audit(_docs(spark, rows).limit(0), labels).count() == 0


# ---- collocations ----------------------------------------------------------------------------------


def _collocations(rows, low, first=2000, longest=5):
    f, n, out = Counter(), Counter(), {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        piece_text = (text or "").translate(LOWER)
        for mark in ".,;:!?\n\x0b\x0c\r":
            piece_text = piece_text.replace(mark, "\n")
        for piece in piece_text.split("\n"):
            own = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(own)
            for k in range(1, longest + 1):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    found = defaultdict(list)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= low}
    covered = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * f[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    for lang, own in found.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:first], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -score)
    return out


@pytest.mark.parametrize("low,first", [(2, 2000), (4, 7)])
def test_collocations_match_plain_version(spark, low, first):
    rng = random.Random(5)
    vocabulary = ["The", "the", "of", "été", "ÉTÉ", "new", "york", "city", "a", "b c", "x" * 300, "\U0001f600"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " \r\n", " "]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text, rng.choice([None, "en", "", "fr"])))
    rows += [(100, None, "en"), (101, "", None), (102, "?!", "de"), (103, "new york city " * 400, "en"), rows[0], rows[0]]
    got = collocations.collocations(_docs(spark, rows), min_count=low, first=first).collect()
    assert {(r.lang, r["rank"]): tuple(r[2:]) for r in got} == _collocations(rows, low, first)


def test_stripes_of_a_block_travel_in_few_rows(spark):
    """op12 finding of round 3: the rows that leave the counting tasks follow the blocks, not the phrases worth counting."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) for _ in range(20)]
    every = SimpleNamespace(value=b"\xff" * (1 << 18))  # a filter that passes every prefix
    run = collocations._stripes(1, every, 1 << 21, np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array(texts)], names=["lang", "text"])
    out = list(run(iter([batch])))
    assert sum(b.num_rows for b in out) <= collocations.BUCKETS
    keys = [k for b in out for own in b.column(1).to_pylist() for k in own]
    assert len(keys) == len(set(keys)) == 3000


def test_stripe_totals_are_the_counts_of_their_prefixes(spark):
    rows = [(i, "a b c d e f a b c x. a b", "en") for i in range(50)]
    _, levels = collocations.phrase_stripes(_docs(spark, rows), min_count=10)
    assert len(levels) == 4
    for shorter, longer in zip(levels, levels[1:]):
        entries = {(r.prefix + " " + e.next): e.n for r in shorter.collect() for e in r.entries}
        totals = Counter()
        for r in longer.collect():
            totals[r.prefix] += r.total
        assert {p: totals[p] for p in entries} == entries


def test_no_frequent_phrase(spark):
    assert collocations.collocations(_docs(spark, [(1, "only a few words", "en")])).collect() == []
    assert collocations.collocations(_docs(spark, [(1, None, None)]).limit(0)).collect() == []


# ---- outlier rules ---------------------------------------------------------------------------------


def _counts(text):
    t = text or ""
    own = [w.decode() for w in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(own) - 7):
        seen[tuple(own[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def _vector(n, chars, symbols, dup, rep):
    raw = [math.log(chars / n), math.log1p(100 * symbols / chars), math.log1p(dup), math.sqrt(rep / n), math.log(n)]
    return [math.floor(v * 1024 + 0.5) / 1024 for v in raw]


FLOORS = np.array([0.05, 0.1, 0.35, 0.2, 0.25])


def _estimate(x):
    c = x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))
    return x.mean(0), c + np.diag(FLOORS**2)


def _d2(x, e):
    return np.einsum("ij,ij->i", x - e[0], np.linalg.solve(e[1], (x - e[0]).T).T)


def _bins(d2):
    return np.floor(32 * np.log(np.maximum(d2, 1e-12))).astype(int)


def _reached(b, share):
    return np.sort(b)[math.ceil(len(b) * share) - 1]


def _mcd(x):
    grid = np.floor(x * 32 + 0.5).astype(int)
    med = np.sort(grid, 0)[math.ceil(len(x) / 2) - 1]
    mad = 1.4826 * np.sort(np.abs(grid - med), 0)[math.ceil(len(x) / 2) - 1] / 32
    near = (np.abs(x - med / 32) <= 2.5 * (mad + FLOORS)).all(1)
    starts = [_estimate(x), (med / 32, np.diag(mad**2 + FLOORS**2))] + ([_estimate(x[near])] if near.any() else [])
    step = lambda e: _estimate(x[_bins(_d2(x, e)) <= _reached(_bins(_d2(x, e)), 0.75)])
    det = lambda e: np.linalg.slogdet(e[1])[1]
    now = min((step(step(e)) for e in starts), key=det)
    for _ in range(20):
        better = step(now)
        if not det(better) < det(now) - 1e-4:
            break
        now = better
    scale = lambda e: max(1.0, math.exp((_reached(_bins(_d2(x, e)), 0.5) + 1) / 32) / 4.35146)
    final = _estimate(x[_bins(_d2(x, now)) <= math.floor(32 * math.log(scale(now) * 12.8325))])
    return final, scale(final)


def _prose(rng, n, symbols=0.0, long=False):
    own = [rng.choice("bcdfg") + rng.choice("aeiou") * rng.randrange(1, 4) + rng.choice(["n", "st", "ring"]) + str(rng.randrange(50)) for _ in range(n)]
    return " ".join("#$%" if rng.random() < symbols else w * (3 if long else 1) for w in own)


def _quality_rows():
    rng = random.Random(9)
    rows = []
    for i in range(360):
        kind = rng.random()
        text = _prose(rng, rng.randrange(30, 200), 0.5 if kind < 0.06 else 0.0, 0.06 <= kind < 0.1)
        rows.append((i, text, ["en", "en", "fr"][i % 3], "a" if i % 2 else ["b", "c", None][i // 2 % 3]))
    line = _prose(rng, 12)
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, (line + "\n") * 30, "en", "a"), (903, _prose(rng, 9000), "en", "a"), rows[0], (None, rows[1][1], "de", "a")]
    return rows + [(904, line + " " + _prose(rng, 60) + " " + line + "\n" + line, "fr", "a")]


def test_outlier_rules_match_plain_version(spark):
    rows = _quality_rows()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n LONG, level STRING").repartition(3)
    got = Counter(tuple(r) for r in outliers.outlier_rules(docs, min_rows=70).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "level", "kept").collect())
    keyed = [(i, lang or "", source or "", _counts(text)) for i, text, lang, source in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for *_, c in keyed]
    fine = [(lang, source, _vector(*c)) for (_, lang, source, c), f in zip(keyed, failed) if not f]
    n_pair, n_lang = Counter((a, b) for a, b, _ in fine), Counter(a for a, _, _ in fine)
    want = Counter()
    for (i, lang, source, c), f in zip(keyed, failed):
        level = None
        kept = False
        if not f:
            level = 2 if n_pair[lang, source] >= 70 else 1 if n_lang[lang] >= 70 else 0
            x = np.array([v for a, b, v in fine if level == 0 or (a == lang and (level == 1 or b == source))])
            e, scale = _mcd(x)
            kept = bool(_d2(np.array([_vector(*c)]), e)[0] <= scale * 25.74483)
        want[(i, *c, f, level, kept)] += 1
    assert got == want
    levels = {r[7] for r in want}
    assert levels == {None, 0, 1, 2}
    verdicts = Counter((r[3] > 5, r[8]) for r in want if r[7] is not None)
    assert verdicts[True, False] >= 15 and verdicts[False, True] > 300


def test_outlier_rules_on_empty_and_failing_tables(spark):
    docs = _docs(spark, [(1, None, "en"), (2, "too short", "en")])
    assert [r.kept for r in outliers.rules_report(docs).collect()] == [False, False]
    assert outliers.rules_report(docs.limit(0)).count() == 0
    assert outliers.outlier_rules(docs.withColumn("text", F.lit("some words " * 30))).where("kept").count() == 0


def test_only_stripes_with_a_counted_next_word_leave_their_task():
    """op12 finding of round 3: prefix totals are known from the pass before, so no row says only how often a prefix stands."""
    texts = [f"a{i}. b{i}, c d" for i in range(200)]
    every = SimpleNamespace(value=b"\xff" * (1 << 18))
    run = collocations._stripes(1, every, 1 << 21, np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array(texts)], names=["lang", "text"])
    out = list(run(iter([batch])))
    assert [x for b in out for own in b.column(1).to_pylist() for x in own] == ["c\n0\nen"]
    assert [x for b in out for own in b.column(2).to_pylist() for x in own] == ["200 d"]
