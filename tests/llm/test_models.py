import random

import numpy as np
from pyspark.sql import functions as F

from loamkit.llm import pfair_mix, quality_bayes, queries
from tests.llm.fixtures import DOCS, awkward, docs, words


def test_period_meets_windows():
    r = random.Random(1)
    for _ in range(40):
        weights = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        total = sum(weights)
        slots = pfair_mix.period(weights)
        assert sorted(np.concatenate(slots).tolist()) == list(range(total))
        for w, s in zip(weights, slots):
            for j, at in enumerate(s.tolist()):
                assert j * total // w <= at < -(-(j + 1) * total // w)
            for t in range(total + 1):
                assert abs(int((s < t).sum()) - w * t / total) < 1


def test_phases_place_every_block_once():
    r = random.Random(2)
    for _ in range(25):
        n = r.randint(1, 6)
        weights, blocks = [r.randint(1, 20) for _ in range(n)], [r.randint(0, 60) for _ in range(n)]
        found = pfair_mix.phases(weights, blocks)
        taken = []
        for s in range(n):
            for b in range(blocks[s]):
                k = max(i for i, p in enumerate(found) if p.done[s] <= b)
                taken.append(found[k].start + int(found[k].slot(s, np.array([b - found[k].done[s]]))[0]))
        assert sorted(taken) == list(range(sum(blocks)))


def test_mix_deviates_by_less_than_a_block(spark):
    sizes = {"a": 400, "b": 120, None: 60, "d": 1}
    rows = [(i, words(3, i), s) for s, n in sizes.items() for i in range(n)]
    targets = {"a": 0.5, "b": 0.3, None: 0.2}
    got = pfair_mix.mix(docs(spark, rows), targets=targets, block_docs=4, bucket_rows=50).collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots.setdefault(r.mix_slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    assert pfair_mix.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_edge_cases(spark):
    df = awkward(spark).selectExpr("*", "1 AS slot", "'old' AS mix_slot", "map('a', text) AS m", "2 AS n")
    got = pfair_mix.mix(df, bucket_rows=2)
    assert got.count() == df.count() and set(df.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert dict(got.dtypes)["mix_slot"] == "bigint" and got.select("mix_position").distinct().count() == df.count()


def test_mix_numbers_rows_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "SUM_BUCKETS", 3)
    df = docs(spark, [(i, f"t{i}", "a" if i % 3 else "b") for i in range(600)])
    got = pfair_mix.mix(df, block_docs=1, bucket_rows=7)
    assert sorted(r.mix_position for r in got.collect()) == list(range(600))


def test_mix_splits_buckets_of_repeated_rows(spark):
    """5 000 equal rows of one source, among others: every row has a place, no bucket holds them all."""
    df = spark.range(5000).selectExpr("1L AS doc_id", "'same' AS text", "'a' AS source").union(spark.range(300).selectExpr("id", "'t' || id", "if(id % 3 = 0, 'b', 'a')"))
    got = pfair_mix.mix(df, block_docs=1, bucket_rows=20).select("source", "mix_position", "text").toPandas()
    assert sorted(got.mix_position) == list(range(5300)) and (got.text == "same").sum() == 5000
    keyed = df.selectExpr("*", "0L AS __pf_source", "xxhash64(text) AS __pf_h").selectExpr("*", "pmod(__pf_h, 265) AS __pf_bucket")
    rows, sizes = pfair_mix._spread(keyed, 20)
    assert sizes.agg({"n": "sum"}).first()[0] == rows.count() == 5300 and sizes.agg({"n": "max"}).first()[0] <= 160


def test_schedule_is_the_same_in_any_pieces():
    whole = np.concatenate([p.table() for p in pfair_mix._pieces([5, 3, 9], [40, 17, 90])], axis=1)
    for rows in (1, 7):
        pieces = list(pfair_mix._pieces([5, 3, 9], [40, 17, 90], rows))
        assert max(len(p.source) for p in pieces) <= rows
        assert (np.concatenate([p.table() for p in pieces], axis=1) == whole).all()


def test_mix_keeps_to_small_targets(spark):
    """0.99985 and 0.00015 of 20 000 slots: every source within one block of its target."""
    df = spark.createDataFrame([("a", 19_997), ("b", 3)], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    got = pfair_mix.mix(df, targets={"a": 0.99985, "b": 0.00015}, block_docs=1).select("source", "mix_slot").toPandas()
    last = min(got.groupby("source").mix_slot.max()) + 1
    t = np.arange(1, last + 1)
    for s, w in (("a", 0.99985), ("b", 0.00015)):
        taken = np.sort(got.mix_slot[got.source == s].to_numpy())
        assert np.abs(np.searchsorted(taken, t) - t * w).max() < 1


def toy(spark, n=600):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        toxic, low = r.random() < 0.2, r.random() < 0.2
        text = words(40, i) + (f" nastyword{r.choice('xyz')}" * 2 if toxic else "")
        if low:
            text = "!! ".join(text.split(" "))
        rows.append((i, text, f"s{i % 7}"))
        labels.append((i, int(not low), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    df, labels = toy(spark)
    got = {r.doc_id: r for r in quality_bayes.classify(df, labels.where("doc_id < 400")).collect()}
    truth = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = [i for i in truth if i >= 400]
    assert sum(got[i].keep == truth[i] for i in held) >= 0.97 * len(held)
    kept = quality_bayes.keep_good(df, labels.where("doc_id < 400"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].keep}


HEAD = quality_bayes.Head(np.zeros(1), np.ones(1), np.zeros(0), 0.0)
PLAIN = quality_bayes.Model({}, {"toxic": HEAD, "low": HEAD})


def rated(spark, rows):
    logit = F.log(F.col("x") / (1 - F.col("x")))
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, site_host string, site_path string, x double").withColumn("ev", F.struct(logit.alias("toxic"), logit.alias("low")))
    sites, priors = quality_bayes.site_sums(scored, PLAIN)
    return sorted(quality_bayes.with_rates(scored, sites, PLAIN, priors).collect(), key=lambda r: r.i)


def test_sparse_sites_shrink_to_their_priors(spark):
    rows = [("big", "p", 0.9)] * 500 + [("big", "q", 0.1)] + [("small", "p", 0.9)] + [(f"h{i}", "p", 0.1) for i in range(300)]
    got = rated(spark, rows)
    assert got[0].toxic_rate > 0.88
    assert got[500].toxic_rate > 0.85  # a sparse path follows its host, not its own document
    assert got[501].toxic_rate < got[500].toxic_rate


def test_rates_match_a_brute_force_grouping(spark):
    r = random.Random(13)
    rows = [(h := f"h{r.randrange(6)}", f"{h}/p{r.randrange(5)}", min(0.99, max(0.01, 0.1 * int(h[1]) + r.random() * 0.3))) for _ in range(400)]
    got = rated(spark, rows)
    whole = sum(x for *_, x in rows) / len(rows)

    def group(key):
        out = {}
        for row in rows:
            out.setdefault(key(row), []).append(row[2])
        return out

    def strength(pairs):  # (rate of the site, its size, rate expected)
        v = np.mean([(s - e) ** 2 for s, _, e in pairs])
        noise, chance = np.mean([e * (1 - e) for *_, e in pairs]), np.mean([e * (1 - e) / n for _, n, e in pairs])
        return min(10_000.0, max(2.0, noise / max(v - chance, 1e-9) - 1))

    hosts, paths = group(lambda x: x[0]), group(lambda x: x[:2])
    kh = strength([(np.mean(x), len(x), whole) for x in hosts.values()])
    prior = {h: (sum(x) + kh * whole) / (len(x) + kh) for h, x in hosts.items()}
    kp = strength([(np.mean(x), len(x), prior[h]) for (h, _), x in paths.items()])
    for row, (h, p, x) in zip(got, rows):
        host = (sum(hosts[h]) - x + kh * whole) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[h, p]) - x + kp * host) / (len(paths[h, p]) - 1 + kp)
        assert abs(row.toxic_host - host) < 1e-9 and abs(row.low_rate - path) < 1e-9


def test_classifier_edge_cases(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_bayes.classify(df, labels)
    assert got.count() == df.count()
    assert {r.doc_id for r in got.where("NOT keep").collect()} >= {1, 2, 3}
    assert quality_bayes.classify(df, labels.limit(0)).count() == df.count()
    assert quality_bayes.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    more = df.selectExpr("*", "1 AS n", "2 AS site_host", "3 AS ev", "map(1, 2) AS h")
    kept = quality_bayes.keep_good(more, labels.withColumn("text", F.lit("x")))
    assert kept.columns == more.columns and kept.count() == quality_bayes.classify(more, labels).where("keep").count()


def test_pipeline_keeps_what_it_should(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    docs_ = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    leaks = {r.doc_id for r in queries.op7_decontaminate(spark, sf).collect()}
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and not leaks & set(ids)
    texts = [docs_[i].text.lower() for i in ids]
    assert len(texts) == len(set(texts))
    assert len({r.mix_position for r in out}) == len(out) >= 0.6 * len(docs_)


def test_mix_follows_the_targets_themselves(spark):
    """Twenty sources of which one holds a third of the rows, over 60 000 slots, by root weights."""
    sizes = {f"s{i:02}": 20_000 if not i else 2_105 for i in range(20)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    got = pfair_mix.mix(df, block_docs=1).select("source", "mix_slot").toPandas()
    whole = sum(n**0.5 for n in sizes.values())
    first = min(got.groupby("source").mix_slot.max()) + 1  # until then all sources are live
    for s, n in sizes.items():
        taken = np.sort(got.mix_slot[got.source == s].to_numpy())
        t = np.arange(1, first + 1)
        assert np.abs(np.searchsorted(taken, t) - t * n**0.5 / whole).max() < 1.001


def test_mix_has_no_least_weight_nor_most_sources(spark):
    """Targets far below a thousandth keep their shares; 1200 sources get a schedule."""
    n = 1200
    targets = {f"s{i}": 1.0 if i % 2 else 0.25 for i in range(n)}
    df = spark.createDataFrame([(s, 4 if t == 1 else 1) for s, t in targets.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS doc_id")
    got = pfair_mix.mix(df, targets=targets, block_docs=1).toPandas()
    assert sorted(got.mix_slot) == list(range(600 * 5))
    for s, slots in got[got.mix_slot < 1500].groupby("source").mix_slot:
        assert abs(len(slots) - 1500 * targets[s] / 750) < 1.001


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item = words(30, 91)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near, twin = words(300, 71), words(200, 72)
    rows = [(None, near, "a"), (7, near + " tail", None), (7, twin, "a"), (8, twin.upper(), "a"), (None, twin, "b"), (9, words(60, 73) + " " + item, "b"), (10, None, None), (11, "", "a"), (12, words(20_000, 74), "b"), (12, words(90, 75), "b")]
    more = docs(spark, rows).selectExpr("*", "'x' AS mix_slot", "map('a', 1) AS row", "1 AS uid")
    more.write.parquet(f"{tmp_path}/documents.parquet")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(7, near + " tail"), (8, twin.upper()), (12, rows[8][1]), (12, rows[9][1])], key=str)
    more.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_match_brute_force(spark, sf):
    """Each stage on what the one before kept, against plain Python on whole texts."""
    import corpus_pipeline

    read = {}
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_ = spark.createDataFrame(stage(spark, docs_, sf).collect(), docs_.schema)
        read[name] = {r.doc_id: r.text for r in docs_.collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for i, t in read["quality"].items():
        last[low(t)] = max(i, last.get(low(t), i))
    assert set(read["exact_dedup"]) == set(last.values())
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in read["exact_dedup"].items() for w in [low(t).split()]}
    holders = {}
    for i, found in grams.items():
        for g in found:
            holders.setdefault(g, set()).add(i)
    for i in set(grams) - set(read["near_dedup"]):  # what went has a near copy
        others = set().union(*(holders[g] for g in grams[i])) - {i}
        assert max((len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for j in others), default=0) >= 0.65
    missed = 0
    for i in read["near_dedup"]:  # of what stayed hardly any has
        others = set().union(*(holders[g] for g in grams[i])) & set(read["near_dedup"]) - {i}
        missed += any(len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8 for j in others)
    assert missed <= 0.02 * len(read["near_dedup"])
    leaks = {r.doc_id for r in queries.op7_decontaminate(spark, sf).collect()}
    assert set(read["decontaminate"]) == set(read["near_dedup"]) - leaks
