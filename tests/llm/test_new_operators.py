"""Collocations, language identification and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hearken.llm import collocations, language_id, turn_repair
from hearken.llm.sql import SQL

LETTERS = "K R D I"


# -- conversation repair ------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) by trying all edit sequences, best first: rows are (initial, fault)."""
    best = {"": (0, "")}

    def insert(best):
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                for r in "ua":
                    if (q, r) in NEXT:
                        t = NEXT[q, r]
                        best[t] = min(best.get(t, (9**9, "")), (c + 3, a + "I"))
        return best

    for initial, fault in rows:
        after: dict = {}
        for q, (c, a) in insert(best).items():
            options = [(q, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(NEXT[q, initial], more, "K")] if (q, initial) in NEXT else []
                options += [(NEXT[q, r], 3 + more, "R") for r in "ua" if (q, r) in NEXT]
            for t, d, e in options:
                after[t] = min(after.get(t, (9**9, "")), (c + d, a + e))
        best = after
    return min(v for q, v in insert(best).items() if q in ("", "a"))


def brute_digest(rows: list[tuple]) -> tuple:
    """The digest of one conversation's rows (turn, role, text), after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append((role[:1], fault))
    cost, audit = cheapest(kinds)
    state, out, left = "", [], list(rows)
    for e in audit:
        speaker = "a" if state == "u" else "u"
        if e == "I":
            out.append({"u": "user:", "a": "assistant:"}[speaker])
        else:
            _, role, text = left.pop(0)
            if e == "D":
                continue
            out.append(f"{role}:{text}" if e == "K" else {"u": "user:", "a": "assistant:"}[speaker] + text)
            speaker = role[:1] if e == "K" else speaker
        state = NEXT[state, speaker]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(f for _, f in kinds)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, initial string").repartition(parts)
    got = turn_repair.digests(turn_repair.edits(frame), frame).collect()
    return {r["conv_id"]: tuple(r[c] for c in DIGEST) for r in got}


def test_repair_of_all_short_conversations(spark):
    kinds = [("system", "S."), ("user", "u?"), ("assistant", "a!"), ("user", "cut"), ("assistant", " "), ("tool", "t.")]
    rows, want = [], {}
    for conv, some in enumerate(itertools.chain.from_iterable(itertools.product(kinds, repeat=n) for n in (1, 2, 3))):
        own = [(t, role, text if t % 2 else f"{text[:-1]}{t}{text[-1:]}" if text.strip() else text) for t, (role, text) in enumerate(some)]
        rows += [(conv, *r, "x") for r in own]
        want[conv] = brute_digest(own)
    assert repaired(spark, rows) == want


def test_repair_of_random_conversations_with_nulls_and_ties(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in [None, *range(60)]:
        own = []
        for _ in range(rng.randint(1, 14)):
            own.append((rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["user", "assistant", "system", "", "Über", None]), rng.choice(["a.", "b", "c! \n", "\t", "", None, "d?", "\u0085", "x" * 3000 + "."])))
        rows += [(conv, *r, None) for r in own]
        want[conv] = brute_digest([(t, " " if r is None else r, " " if x is None else x) for t, r, x in own])
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, 7) == want


def test_repair_of_a_long_conversation_and_of_nothing(spark):
    rng = random.Random(6)
    own = [(t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('.x')}") for t in range(30_000)]
    got = repaired(spark, [(1, *r, "") for r in own])[1]
    assert got[5] == brute_digest(own)[5] and got[6] == brute_digest(own)[6]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.digests(turn_repair.edits(empty), empty).count() == 0


def test_repaired_rows_are_well_formed(spark):
    import re

    rows = [(c, t, r, x, "") for c in range(40) for t, (r, x) in enumerate(random.Random(c).choices([("user", "u."), ("assistant", "a"), ("system", "s.")], k=9))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string")
    found = turn_repair.edits(frame).toPandas()
    for _, own in found.groupby("conv_id"):
        kept = own.sort_values("step")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in kept[kept.edit != "D"].role))
        assert set(own.edit) <= set(LETTERS.split())


def test_damage_and_whole_conversations_that_vanish(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {t}. No! Yes?") for c in range(300) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want: dict = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(x for x in text if x not in ".!?") if hit == 2 else text
            want[c] += [(t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    got = turn_repair.digests(turn_repair.edits(turn_repair.damage(frame)), frame).collect()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {r["conv_id"]: tuple(r[c] for c in DIGEST) for r in got} == {c: brute_digest(v) if v else nothing for c, v in want.items()}


def test_auction_prices_are_distances():
    """Against shortest distances by repeated relaxation."""
    for kind in [("u", ""), ("a", "truncated"), ("s", "blank"), (" ", ""), turn_repair.END]:
        layer = turn_repair.arcs(kind)
        for beyond in itertools.product(range(0, 9, 2), repeat=4):
            far = [10**6] * 4
            for _ in range(5):
                far = [min(c + (beyond[s] if out else far[s]) for _, c, out, s in layer[q]) for q in range(4)]
            assert turn_repair.auction(layer, beyond) == far


# -- collocations ------------------------------------------------------------------------


def brute_phrases(docs, least, percent=80, most=2000):
    import re

    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    kept = []
    for (lang, w), a in cand.items():
        inside = any(
            lg == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= percent * a for (lg, v), b in cand.items()
        )
        if not inside:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = ["the", "of", "new", "york", "City", "a", "été", "x y", "no\u0085t", "q"] + [f"w{i}" for i in range(60)]
    made = []
    for _ in range(size):
        some = rng.choices(words, weights=[9, 9, 5, 5, 5, 4, 3, 2, 2, 2] + [1] * 60, k=rng.randint(0, 60))
        made.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t"]).join(some).replace("q", ". ").replace("new", "New york")))
    return made + [("en", None), (None, ""), ("fr", "..., \n"), ("en", "the of " * 3000), ("en", " \t " * 1000)] + [("fr", "un deux trois quatre cinq.")] * 40


def mined(spark, docs, parts=3, **more):
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "lang string, text string, phrase string").repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(frame, **more).collect())


def test_collocations_equal_brute_force(spark):
    docs = corpus(1, 500)
    want = sorted(brute_phrases(docs, 8))
    assert len(want) > 30
    assert mined(spark, docs, least=8) == want
    assert mined(spark, docs, 1, least=8) == want
    assert mined(spark, docs, least=8, most=5) == sorted(brute_phrases(docs, 8, most=5))


def test_collocations_of_nothing(spark):
    assert mined(spark, [(None, None)], 1, least=1) == []
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_phrases_across_many_ranges_and_a_full_bit_set(spark):
    docs = corpus(2, 60)
    frame = spark.createDataFrame(docs, "lang string, text string")
    small, _ = collocations.phrases(frame, 6)
    spread, _ = collocations.phrases(frame, 6, bits=15, chunk=500, rows=40)
    rows = lambda d: sorted((tuple(r["ids"]), r["a"]) for r in d.collect())
    assert rows(small) == rows(spread) and len(rows(small)) > 50


def test_two_words_with_one_number_take_another_seed(spark, monkeypatch):
    first = collocations.numbers("en", ["the", "of"], 0).tolist()
    clash = [[{"id": first[0] if seed == 0 else i, "lang": "en", "word": w, "n": 5} for i, w in enumerate(("the", "of"))] for seed in (0, 1)]

    def fake(chunk, seed):
        import pyarrow as pa

        return lambda batches: iter([pa.RecordBatch.from_pylist(clash[seed])])

    monkeypatch.setattr(collocations, "_vocabulary", fake)
    words, seed = collocations.vocabulary(spark.createDataFrame([("en", "x")], "lang string, text string").coalesce(1), 100)
    assert seed == 1 and words.count() == 2


def test_three_way_counts_every_frequent_prefix():
    rng = np.random.default_rng(3)
    keys = np.where(np.cumsum(rng.random((5000, 4)) < 0.2, axis=1) > 0, 0, rng.zipf(1.6, (5000, 4)) % 50 + 1)
    counts = rng.integers(1, 4, 5000)
    want: Counter = Counter()
    for row, n in zip(keys.tolist(), counts.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += n
    got = {}
    for at, depth, n in collocations.three_way(keys, counts, 30):
        for a, c in zip(at, n):
            assert tuple(keys[a, :depth]) not in got
            got[tuple(keys[a, :depth])] = c
    assert got == {p: n for p, n in want.items() if n >= 30}
    hot = np.ones((200_000, 4), dtype=np.int64)
    assert [(d, n.tolist()) for _, d, n in collocations.three_way(hot, np.ones(200_000), 30)] == [(d, [200_000]) for d in (1, 2, 3, 4)]


def test_words_are_split_at_blanks_only():
    import pyarrow as pa

    words, at, piece = collocations.words_of(pa.array(["A b\tc.D  é", "", "x y,\rZ", " "]))
    assert [words[i] for i in at] == ["a", "b", "c", "d", "é", "x y", "z"]
    assert len(set(piece[:3])) == 1 and piece[3] == piece[4] and piece[2] < piece[3] < piece[5] < piece[6]


# -- language identification ---------------------------------------------------------------


def brute_vector(text: str, dims: int, order: int = 3, seed: int = 1) -> np.ndarray:
    letters = language_id.Letters(dims, order, seed)
    gaps = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    codes = [ord(c) if c != " " else 0 for c in " ".join([""] + gaps.split() + [""])]
    total = np.zeros(dims, dtype=np.int64)
    for i in range(len(codes) - order + 1):
        gram = np.ones(dims, dtype=np.int64)
        for place, c in enumerate(codes[i : i + order]):
            gram = gram * np.roll(letters.vector(c).astype(np.int64), order - 1 - place)
        total += gram
    return total


def test_prototypes_and_scores_equal_brute_force(spark):
    texts = [("en", "The quick brown fox, 12 times."), ("de", "Füchse springen über Hunde"), ("en", "lazy dog's"), (None, "niemand"), ("de", None), ("de", "日本語 Ž")]
    frame = spark.createDataFrame([(l, t, i) for i, (l, t) in enumerate(texts)], "lang string, text string, doc_id long")
    found = language_id.prototypes(frame, dims=256)
    got = {r["lang"]: np.array(r["vector"]) for r in found.collect()}
    want = {l: sum(brute_vector(t, 256) for k, t in texts if k == l and t) for l in ("en", "de")}
    assert set(got) == {"en", "de"} and all((got[l] == want[l]).all() for l in want)
    asked = [(1, "the dog"), (2, "über"), (3, None), (4, "12 !?"), (5, ""), (6, "a" * 50_000 + " b"), (7, "the dog")]
    docs = spark.createDataFrame([(*a, 1.0) for a in asked], "doc_id long, text string, score double")
    for piece in (1 << 20, 7):
        rows = {r["doc_id"]: r for r in language_id.predict(docs.repartition(2), found, dims=256, piece=piece).collect()}
        for i, text in asked:
            vector = brute_vector(text, 256) if text and any(c.isalpha() for c in text) else None
            if vector is None:
                assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
                continue
            cosines = {l: vector @ v / np.linalg.norm(vector) / np.linalg.norm(v) for l, v in want.items()}
            best = max(sorted(cosines), key=cosines.get)
            assert rows[i]["lang_pred"] == best and rows[i]["score"] == pytest.approx(max(cosines[best], 0), abs=1e-6)


def test_language_id_without_training_rows_or_rows(spark):
    schema = "doc_id long, text string, lang string, held_out boolean, lang_pred string"
    none = spark.createDataFrame([(1, "abc", None, False, "x"), (2, None, "en", False, "x")], schema)
    assert {r["lang_pred"] for r in language_id.identify(none).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        language_id.prototypes(none.withColumn("lang", none["doc_id"].cast("string")).fillna("x"), most_languages=1)


def test_held_out_languages_are_found(spark):
    from hearken.llm import queries

    got = queries.op12_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == len(docs) and len(held) > 150
    assert (held.lang == held.lang_pred).mean() >= 0.99
    assert got.score.between(0, 1).all()


def test_new_queries_have_sql():
    assert {"op11_collocations", "op13_turn_repair"} <= set(SQL)


# -- the scatter estimate of the quality rules --------------------------------------------


def brute_scatter(x: np.ndarray, share: float, steps: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of one group by the operator's steps, row by row."""
    from hearken.llm import quality_mcd as Q

    d = x.shape[1]
    floor = np.diag([Q.FLOORS[f] ** 2 for f in Q.FEATURES])
    bins = np.floor(x * 2048)
    low_median = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    med = low_median(bins)
    mad = low_median(np.abs(bins - med))
    mean, cov = (med + 0.5) / 2048, np.diag((1.4826 * mad / 2048) ** 2) + floor
    raw, inner = share / Q._chi2_cdf(Q.chi2_quantile(share, d), d + 2), Q.chi2_quantile(0.975, d)
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(steps):
        d2 = distance(mean, cov)
        b = np.floor(np.log2(d2 + 1e-9) * 32)
        cut = 2.0 ** ((np.sort(b)[int(np.ceil(len(x) * share)) - 1] + 1) / 32)
        kept = x[d2 <= cut]
        mean, cov = kept.mean(axis=0), (np.cov(kept.T, bias=True) + floor) * raw
    kept = x[distance(mean, cov) <= inner]
    return len(kept), kept.mean(axis=0), np.cov(kept.T, bias=True) + floor


def test_scatter_of_sources_languages_and_all(spark):
    from hearken.llm import quality_mcd as Q

    rng = np.random.default_rng(11)
    rows = []
    for lang, source, n, shift in [("en", "a", 400, 0.0), ("en", "b", 60, 1.0), ("de", "a", 150, -1.0), (None, "c", 7, 0.5)]:
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + shift
        x[: n // 10] += 25
        rows += [(lang, source, *map(float, v)) for v in x]
    counts = {c: 100 for c in Q.BASE} | {"n_repeat_words": 0}
    frame = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double").selectExpr("*", *[f"cast({v} as long) as {c}" for c, v in counts.items()])
    got = {r["g"]: r for r in Q.fit(frame, prior=200.0).collect()}
    x = np.array([r[2:] for r in rows])
    keys = [r[:2] for r in rows]

    def blend(own, base):
        n, m, c = own
        w = n / (n + 200.0)
        away = m - base[1]
        return n, w * m + (1 - w) * base[1], w * c + (1 - w) * base[2] + w * (1 - w) * np.outer(away, away)

    every = brute_scatter(x, 0.75, 3)
    settled = 0.975 / Q._chi2_cdf(Q.chi2_quantile(0.975, 4), 6)
    name = lambda *v: "/".join([*("-" if k is None else f"={k}" for k in v), str(len(v))])
    for lang, source in sorted(set(keys), key=str):
        of = lambda test: x[[test(k) for k in keys]]
        base = blend(brute_scatter(of(lambda k: k[0] == lang), 0.75, 3), every)
        _, mean, cov = blend(brute_scatter(of(lambda k: k == (lang, source)), 0.75, 3), base)
        r = got[name(lang, source)]
        lower = np.array([[r[f"l_{a}_{b}"] if j <= i else 0.0 for j, b in enumerate(Q.FEATURES)] for i, a in enumerate(Q.FEATURES)])
        assert np.allclose([r[f"m_{a}"] for a in Q.FEATURES], mean, atol=1e-9)
        assert np.allclose(lower @ lower.T, cov * settled, rtol=1e-8, atol=1e-9)
