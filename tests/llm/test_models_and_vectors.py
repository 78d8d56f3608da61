"""Classifiers on held-out rows, vectors and mixing against brute force, and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 60] + rng.normal(size=16) * 0.05]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None] * 8), (2100, [float("inf")] * 16), (2005, [1.0, 2.0]), (0, rows[0][1]), (None, rows[3][1])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, links long, node string")


def usable(r):
    return bool(r.embedding) and None not in r.embedding and np.isfinite(r.embedding).all() and len(r.embedding) == 16


def test_near_duplicates_reach_brute_force(spark):
    from calibra.llm.pivot_dedup import near_duplicates

    df = vectors(spark)
    rows = df.collect()
    good = [i for i, r in enumerate(rows) if usable(r) and any(r.embedding)]
    x = np.array([rows[i].embedding for i in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    links = sum(r.n_links for r in got)
    assert 0.9 * (near.sum() - len(good)) <= links <= near.sum() - len(good)
    by = {r.vec_id: r for r in got}
    for i in (2000, 2001, 2002, 2003, 2004, 2100):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[1000].component_id == 0 and not by[1000].kept and by[1000].n_links >= 5
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_links_of_each_cosine_band_are_found(spark, dim):
    """Row by row against brute force: no false link, and 0.95 of the planted pairs of each band."""
    from calibra.llm.pivot_dedup import near_duplicates

    rng, n, planted = np.random.default_rng(11), 6_000, 1_500
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(rng.normal(size=(n, dim)))
    away = rng.normal(size=(planted, dim))
    away = unit(away - (away * base[:planted]).sum(1, keepdims=True) * base[:planted])
    bands = ((0.9002, 0.92), (0.92, 0.95), (0.95, 0.9999))
    cosine = np.concatenate([rng.uniform(lo, hi, (planted // 3, 1)) for lo, hi in bands])
    x = np.concatenate([base, cosine * base[:planted] + np.sqrt(1 - cosine**2) * away])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    got = sorted(near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect())
    links = np.array([r.n_links for r in got])
    assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
    for b in range(3):
        rows = slice(n + b * planted // 3, n + (b + 1) * planted // 3)
        assert links[rows].sum() >= 0.95 * want[rows].sum()
    # classes join only what brute force joins, and every row with a link is in its partner's class
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(near)):
        a, c = sorted((find(int(i)), find(int(j))))
        parent[c] = a
    root = [find(i) for i in range(len(x))]
    assert all(root[r.component_id] == root[i] and r.component_id <= i and r.kept == (r.component_id == i) for i, r in enumerate(got))
    assert sum(r.component_id == root[i] for i, r in enumerate(got)) >= 0.95 * len(x)


@pytest.mark.parametrize("dim", [8, 16, 64, 256])
@pytest.mark.parametrize("n", [800, 4096])
def test_order_of_pivots_finds_pairs_at_the_threshold(dim, n):
    """6,000 planted pairs at a cosine of 0.9, none of which took part in the fit; first lists are shared ones."""
    from calibra.llm import pivot_dedup as d

    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    pivots, span = d.fitted_pivots(unit(rng.normal(size=(2 * n, dim))), n)
    x = unit(rng.normal(size=(6_000, dim)))
    away = rng.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(0.19) * unit(away - (away * x).sum(1, keepdims=True) * x)
    m = min(span + 1, len(pivots))
    a, b = (d.nearest(v, pivots, m).astype(np.int16) for v in (x, y))
    first = d._first_list(a, b, span, 3, 0)
    assert (first >= 0).mean() >= 0.95 and span <= d.SPAN

    def listed(order):
        return {(min(order[i], order[j]), max(order[i], order[j])) for i in range(m) for j in range(i + 1, m) if i + j <= span}

    for p, q, got in zip(a[:300].tolist(), b[:300].tolist(), first.tolist()):
        both = listed(p) & listed(q)
        assert got == (min(both)[0] * d.MOST_PIVOTS + min(both)[1] % 3 if both else -1)


def test_vectors_whose_squares_leave_the_range_of_doubles(spark):
    from calibra.llm.pivot_dedup import near_duplicates

    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 2.0]) for i in range(40)] + [(100, [1e200, 0.0, -1e200]), (101, [1e-200, 0.0, -1e-200]), (102, [0.0, 0.0, 0.0]), (103, [1.0, 0.0, -1.0])]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in (100, 101, 102, 103)] == [(2, 100), (2, 100), (0, 102), (2, 100)]


def test_each_dimension_is_indexed(spark):
    from calibra.llm.pivot_dedup import near_duplicates

    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 1.0 * (i % 7)]) for i in range(50)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [1.01, 2.0]), (103, [-1.0, 2.0])]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in (100, 101, 102, 103)] == [(2, 100), (2, 100), (2, 100), (0, 103)]


@pytest.mark.parametrize("shape", [{}, {"SHARD": 600, "QUERY_BLOCK": 16}])
def test_top_k_equals_brute_force(spark, monkeypatch, shape):
    """Repeated ids are rows of their own; nameless rows are candidates, last among ties."""
    from calibra.llm import maxscore

    for name, value in shape.items():
        monkeypatch.setattr(maxscore, name, value)
    df = vectors(spark)
    rows = []
    for r in df.collect():
        if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all():
            v = np.zeros(16, np.int64)
            v[: len(r.embedding)] = np.floor(1024 * np.array(r.embedding, float)).astype(np.int64)
            rows.append((r.vec_id, v))
    want = []
    for at, (q, x) in enumerate(rows):
        if q is not None and q % 100 == 0:
            best = sorted((-int(x @ v), i is None, i or 0) for n, (i, v) in enumerate(rows) if n != at)[:10]
            want += [(q, n + 1, None if nameless else i, -s) for n, (s, nameless, i) in enumerate(best)]
    got = [tuple(r) for r in maxscore.exact_top_k(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    two = spark.createDataFrame([(1, [2.0]), (1, [5.0]), (100, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in maxscore.exact_top_k(two).collect()) == [(100, 1, 1, 5120 * 1024), (100, 2, 1, 2048 * 1024)]
    assert maxscore.exact_top_k(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        maxscore.exact_top_k(spark.createDataFrame([(100, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"))


def test_cycle_is_pfair():
    from calibra.llm.mixing import pfair_cycle, slots_of_weights

    for weights in ({"a": 5, "b": 3, "c": 1, "d": 0.01}, {str(i): 1 + i % 7 for i in range(40)}, {"x": 1}):
        given = slots_of_weights(weights, 200)
        cycle, total = pfair_cycle(given), sum(given.values())
        assert [t for *_, t in cycle] == list(range(total))
        seen = dict.fromkeys(given, 0)
        for s, j, t in cycle:
            assert j == seen[s] and j * total // given[s] <= t < -(-(j + 1) * total // given[s])
            seen[s] += 1
            assert all(abs(seen[x] - given[x] / total * (t + 1)) < 1 for x in given)


def test_slots_keep_to_the_exact_weights(spark):
    from fractions import Fraction

    from calibra.llm.mixing import mix_plan, pfair_slots

    sizes = {f"s{i}": 500 + 997 * i for i in range(19)} | {"big": 80_000}
    for weights in ({s: n**0.5 for s, n in sizes.items()}, {s: 1.0 for s in sizes} | {"s1": 1e-5}):
        total = sum(map(Fraction, weights.values()))
        slots = pfair_slots(weights, sizes)
        assert len({t for x in slots.values() for t in x}) == sum(sizes.values())
        for s, x in slots.items():
            w = Fraction(weights[s]) / total
            assert len(x) == sizes[s] and all(j / w - 1 < t < (j + 1) / w for j, t in enumerate(x) if j % 97 == 0 or j + 1 == len(x))
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('s', cast(sqrt(id) / 20 as int)) as source")
    plan = mix_plan(docs, {f"s{i}": 1.0 + i / 7 for i in range(12)}).toPandas()
    total = sum(1.0 + i / 7 for i in range(12))
    assert len(set(plan.mix_position)) == 60_000
    for s, n, t in zip(plan.source, plan.block, plan.slot):
        if s != "s12":
            w = (1.0 + int(s[1:]) / 7) / total
            assert n / w - 1.01 < t < (n + 1) / w + 0.01


def test_pipeline_returns_the_mix_position(spark):
    import corpus_pipeline as cp
    from calibra.llm.mixing import mix_plan

    docs = table(spark, "documents").limit(300).cache()
    out = cp.tokenize(spark, cp.mix_sources(spark, docs, DATA), DATA).collect()
    assert {(r.doc_id, r.mix_position) for r in out} == {(r.doc_id, r.mix_position) for r in mix_plan(docs).collect()}


def test_mix_places_every_row_once(spark):
    from calibra.llm.mixing import in_mix_order, mix_plan

    docs = table(spark, "documents")
    plan = mix_plan(docs).collect()
    assert len({r.mix_position for r in plan}) == docs.count() and sorted(r.doc_id for r in plan) == sorted(r.doc_id for r in docs.collect())
    ordered = in_mix_order(docs)
    assert ordered.columns == docs.columns and [r.doc_id for r in ordered.collect()] == [r.doc_id for r in sorted(plan, key=lambda r: r.mix_position)]
    only = mix_plan(docs, {"src1": 2.0, "src2": 1.0}).toPandas().sort_values("mix_position")
    assert set(only.head(100).source) == {"src1", "src2"}


def test_mix_keeps_columns_of_any_name(spark):
    from calibra.llm.mixing import in_mix_order, mix_plan, with_mix_position

    names = ["_src", "_block", "_share", "_number", "_slot", "src", "block", "number", "slot", "row", "hash", "bucket", "rank", "before", "chunk", "slots", "id", "position"]
    rows = [(None if i % 7 == 0 else i // 2, None if i % 5 == 0 else f"s{i % 3}", *[i] * len(names)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} long" for n in names))
    ordered = in_mix_order(d)
    assert ordered.columns == d.columns and sorted(map(str, ordered.collect())) == sorted(map(str, d.collect()))
    placed = with_mix_position(d)
    assert placed.columns == [*d.columns, "mix_position"] and len({r.mix_position for r in placed.collect()}) == 200
    assert len({r.mix_position for r in mix_plan(d).collect()}) == 200 and with_mix_position(placed).columns == placed.columns


def test_large_tables_have_larger_blocks(spark, monkeypatch):
    from calibra.llm import mixing

    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    d = spark.range(4_000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    plan = mixing.mix_plan(d).toPandas()
    assert len(set(plan.mix_position)) == 4_000 and plan.groupby(["source", "block"]).size().max() == 80


@pytest.mark.parametrize("kind,mod,rest", [("toxic", 3, 1), ("quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, kind, mod, rest):
    from calibra.llm.quality import quality_scores
    from calibra.llm.toxicity import toxicity_scores

    docs, labels = table(spark, "documents"), table(spark, "labels")
    out = (toxicity_scores if kind == "toxic" else quality_scores)(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % mod == rest) == h for i, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    ones, zeros = held[held[kind] == 1].predicted.mean(), 1 - held[held[kind] == 0].predicted.mean()
    hits = held[held.predicted == 1]
    if kind == "toxic":
        assert ones >= 0.6 and (hits[kind] == 1).mean() >= 0.9
    else:
        assert (ones + zeros) / 2 >= 0.75


def test_quality_with_few_positives(spark):
    from calibra.llm.quality import quality_scores

    docs = spark.createDataFrame([(i, "some words here " * (i + 1)) for i in range(12)] + [(3, None), (None, "")], "doc_id long, text string")
    for n in (0, 1, 2, 3):
        labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
        out = quality_scores(docs, labels).toPandas()
        assert len(out) == 14 and out.score.between(0, 1).all()


def test_quality_fit_equals_plain_descent(spark, monkeypatch):
    """Sums of tasks, weights and calibration against plain sums, gradient descent on the stated risk and sorted shares."""
    from calibra.llm import quality as ql

    monkeypatch.setattr(ql, "DECAY", 0.02)  # so that plain descent arrives
    monkeypatch.setattr(ql, "BINS", 3)
    labels, kinds = {r.doc_id for r in table(spark, "labels").where("quality = 1").collect()}, ql._kinds()
    docs = table(spark, "documents")
    rows = [(r.doc_id, ql.statistics([r.text or ""], kinds)[0]) for r in docs.collect()]
    every, good = np.array([x for _, x in rows]), np.array([x for i, x in rows if i in labels])
    cells = ql.stat_cells(every)
    model = ql.BinnedLogistic(np.stack([np.bincount(c, minlength=ql.STAT_CELLS[1]) for c in cells.T]))
    assert model.n == len(every) and np.allclose(model.mean, every.mean(0), rtol=2e-3, atol=2e-3)
    of = ql.risk_sums(model, np.linspace(-1, 1, len(model.weights)))
    by_task = ql.sums_over(ql._with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(7)).select("x"))
    assert np.allclose(by_task(of), of(every), rtol=1e-9)
    u, p, prior = model.expand(every), model.expand(good), 0.4
    ql.fit_non_negative(model, good, lambda f: f(every), prior)
    plain = lambda z: 1 / (1 + np.exp(-z))
    rate, w = 4 / np.linalg.eigvalsh(u.T @ u / len(u))[-1], np.zeros(u.shape[1])
    for _ in range(60_000):
        grad = u.T @ plain(u @ w) / len(u) - prior * (p.T @ plain(p @ w)) / len(p) + prior * (p.T @ (plain(p @ w) - 1)) / len(p) + 0.02 * w
        w -= rate * grad
        if np.abs(grad).max() < 1e-8:
            break
    assert np.abs(grad).max() < 1e-6 and np.logaddexp(0, u @ w).mean() >= prior * np.logaddexp(0, p @ w).mean()
    assert np.abs(w - model.weights).max() < 1e-4
    z = np.sort(model.margin(every))
    counts = lambda x: np.bincount(ql.margin_cells(model.margin(x)), minlength=ql.MARGIN_CELLS[1])
    model.calibrate(counts(good), counts(every), prior)
    share = np.diff(np.concatenate([[0], np.searchsorted(z, model.edges_of_margin), [len(z)]])) / len(z)
    assert abs((model.level * share).sum() - prior) < 0.02 and (np.diff(model.level) >= 0).all()
    # a prior beyond the texts' share: the fit stops where the negative part is still not below zero
    edge = ql.BinnedLogistic(np.stack([np.bincount(c, minlength=ql.STAT_CELLS[1]) for c in cells.T]))
    ql.fit_non_negative(edge, good, lambda f: f(every), 0.97)
    assert np.logaddexp(0, edge.margin(every)).mean() - 0.97 * np.logaddexp(0, edge.margin(good)).mean() >= -1e-4


def test_prior_equals_a_sorted_scan():
    from calibra.llm import quality as ql

    rng = np.random.default_rng(3)
    p, u = rng.normal(2, 1, 2_000), np.concatenate([rng.normal(2, 1, 6_000), rng.normal(-3, 1, 4_000)])
    counts = lambda z: np.bincount(ql.margin_cells(z), minlength=ql.MARGIN_CELLS[1])
    got = ql.class_prior(counts(p), counts(u))
    slack = np.sqrt(np.log(120) / (2 * len(p))) + np.sqrt(np.log(120) / (2 * len(u)))
    ratios = [(((u >= c).mean() + slack) / (p >= c).mean(), (u >= c).mean() / (p >= c).mean()) for c in np.sort(p)[:: len(p) // 60]]
    assert abs(got - min(ratios)[1]) < 0.02 and abs(got - 0.6) < 0.05
    assert ql.class_prior(np.zeros(4_096), counts(u)) == 0.5


def test_toxicity_scores_equal_the_plain_formula(spark):
    """Scores from the fitted parts by plain Python, token by token and without a memory."""
    import math

    from calibra.llm.toxicity import LEAK, Restorer, char_model, features_of, fit_lexicon, toxicity_scores

    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = char_model(docs)
    lexicon, leak = fit_lexicon(docs, labels, model, 3, 1)
    r, texts = Restorer(model), {x.doc_id: x.text or "" for x in docs.collect()}
    assert leak == LEAK and lexicon
    for row in toxicity_scores(docs, labels).collect():
        low, clean = texts[row.doc_id].lower(), 1 - leak
        read = [r.readings(t) for t in dict.fromkeys(low.split())] + [(w,) for w in r.spaced(low)]
        for readings in read:
            clean *= 1 - max((lexicon.get(f, 0.0) for w in readings for f in features_of(w)), default=0.0)
        assert math.isclose(row.score, 1 - clean, abs_tol=1e-9)


def test_char_model_counts_every_character(spark, monkeypatch):
    from calibra.llm import toxicity

    docs = spark.createDataFrame([(1, "abcab cde " * 50), (2, None), (3, "x")], "doc_id long, text string").coalesce(1)
    whole = toxicity.char_model(docs)
    monkeypatch.setattr(toxicity, "SLICE", 1 << 20)
    table_ = toxicity._class_table()
    text = "  " + "  ".join(["abcab cde " * 50, "", "x"]) + " "
    code = table_[np.array([ord(c) for c in text])].astype(int)
    counts = np.zeros((toxicity.N_CLASSES,) * 3)
    np.add.at(counts, (code[:-2], code[1:-1], code[2:]), 1)
    two = counts.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + toxicity.N_CLASSES)
    p2 = (two + 8 * one) / (two.sum(1, keepdims=True) + 8)
    assert np.allclose(whole, np.log((counts + 8 * p2[None]) / (counts.sum(2, keepdims=True) + 8)), atol=1e-5)


def test_disguised_words_are_read(spark):
    from calibra.llm.toxicity import Restorer, char_model

    r = Restorer(char_model(table(spark, "documents")))
    for raw, word in (("stup1d", "stupid"), ("p@thet1c", "pathetic"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash")):
        assert word in r.readings(raw)
    assert "stupid" in r.spaced("so s t u p i d that") and r.readings("the,") == ("the",) and r.readings("of%%%") == ("of",)


def test_long_disguised_tokens_are_read(spark):
    from calibra.llm.toxicity import Restorer, char_model

    r = Restorer(char_model(table(spark, "documents")))
    assert "stupid" in r.readings("stu" + "u" * 40 + "pid") and "pathetic" in r.readings("p@" + "@" * 30 + "thet" + "1" * 30 + "c")
    joined = r.readings("stup1d-m0r0n/tr@sh_p@thet1c-stuuuupid-m0r0n-tr@sh")
    assert {"stupid", "moron", "trash", "pathetic"} <= set(joined)
    assert {"stupid", "moron"} <= set(r.readings("stup1d+m0r0n"))


def test_languages_on_held_out_rows(spark):
    from calibra.llm.language import language_predictions

    docs = table(spark, "documents")
    out = language_predictions(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() >= 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "the word", None), *[(i, "the other word", "en") for i in range(10, 20)], *[(i, "le mot", "fr") for i in range(20, 30)]], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_predictions(odd).collect()}
    assert got[1] == got[2] == "und" and got[3] in ("en", "fr")


def test_language_scores_equal_plain_kernels(spark):
    """Kernels of plain n-gram sets and ridge regression solved in the dual give the same languages and scores."""
    from calibra.llm import language

    docs = table(spark, "documents")
    net, _, languages = language.fit_languages(docs, 3, 1)
    marks = [{int(c) for c in net.vocabulary.codes[net.has[:, i] > 0]} for i in range(net.has.shape[1])]
    known = set().union(*marks)

    def row(text):
        low = (" " + text.lower() + " ").encode()
        n = max(1, round(len(low) / 4096))
        total, weights = np.zeros(len(marks)), 0.0
        for part in (low[len(low) * i // n : len(low) * (i + 1) // n] for i in range(n)):
            grams = [[(k << 40) + int.from_bytes(part[i : i + k], "big") for i in range(len(part) - k + 1)] for k in (1, 2, 3, 4)]
            seen = known & set().union(*grams)
            longest = [x for x in grams if x][-1]
            weight = max(1e-3, sum(x in known for x in longest) / len(longest)) ** 4
            total += weight * np.array([len(seen & m) / np.sqrt(max(1, len(seen)) * len(m)) for m in marks])
            weights += weight
        return total / weights

    rows = docs.collect()
    train = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    test = [r for r in rows if any(map(str.isalpha, r.text or ""))][:80]
    c, t = np.array([row(r.text) for r in train]), np.array([row(r.text) for r in test])
    between = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    inner = np.linalg.pinv(between, rcond=1e-6, hermitian=True)
    ridge = 1e-3 * len(train) / (np.linalg.matrix_rank(between, tol=1e-6 * np.linalg.norm(between, 2), hermitian=True) + 1)
    y = np.array([[1.0 if r.lang == x else -1.0 for x in languages] for r in train])
    margin = (t @ inner @ c.T + 1) @ np.linalg.solve(c @ inner @ c.T + 1 + ridge * np.eye(len(train)), y)
    score = 1 / np.exp(4 * (margin - margin.max(1, keepdims=True))).sum(1)
    got = {r.doc_id: r for r in language.language_predictions(docs).collect()}
    assert [got[r.doc_id].lang_pred for r in test] == [languages[i] for i in margin.argmax(1)]
    assert np.allclose([got[r.doc_id].score for r in test], score, atol=1e-6)


def test_noise_does_not_change_the_language(spark):
    """Images in base64 behind a text, however long, and long texts leave its language."""
    import base64

    from calibra.llm.language import language_predictions

    docs = table(spark, "documents").select("doc_id", "text", "lang")
    texts = {x: [r.text for r in docs.where(f"lang = '{x}' and length(text) > 500").orderBy("doc_id").limit(40).collect()] for x in ("de", "fr", "es")}
    noise = base64.b64encode(np.random.default_rng(3).bytes(90_000)).decode()
    rows = [(10**6 + 100 * k + i, text + " " + noise[:n], None, x) for k, (x, some) in enumerate(texts.items()) for i, (text, n) in enumerate([*((t, n) for t in some[:3] for n in (0, 2_000, 8_000, 30_000, 120_000)), ("\n".join(some * 20)[:1_000_000], 100_000)])]
    odd = spark.createDataFrame([r[:3] for r in rows], docs.schema)
    got = {r.doc_id: r for r in language_predictions(docs.unionByName(odd)).collect()}
    assert all(got[r[0]].lang_pred == r[3] for r in rows)


def test_components(spark):
    from calibra.llm.components import connected_components

    chain = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(30)] + [(500, 500), (7, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(30)) and 500 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, "documents")
    out = cp.run(spark, DATA).toPandas()
    toxic = {r.doc_id for r in table(spark, "labels").where("toxic = 1").collect()}
    labelled_clean = {r.doc_id for r in table(spark, "labels").where("toxic = 0").collect()}
    clean = cp.drop_toxic(spark, docs, DATA)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and len(toxic & ids) < 0.5 * len(toxic) and len(labelled_clean - ids) <= 2
    single = cp.drop_near_duplicates(spark, clean, DATA)
    want = {r.doc_id for r in single.collect()}
    assert set(out.doc_id) == want and len(out) == len(want)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "mix_sources", "bpe"]
