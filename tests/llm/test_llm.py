"""The operators on training data against brute force, and on nulls, empty tables, repeats and odd columns."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import (
    decontamination,
    language,
    minhash,
    mixing,
    pii,
    quality,
    sharding,
    suffix_dedup,
    toxicity,
    urls,
)

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, id string, k long, kept string"
GAP = "[\x20\x09-\x0d]+"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def table(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, "x", 7, "y") for i, t, s in rows], COLUMNS)


LONG = " ".join(f"word{i % 97}x{i}" for i in range(400))
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n", "a"),
    (None, LONG, "b"),
    (4, LONG, "b"),
    (4, LONG, "b"),
    (5, "é😀 word", None),
    (6, "the same the same the same " * 40, "c"),
    (7, "the same the same the same " * 40, "c"),
]


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(params=["odd", "empty"])
def odd(request, spark):
    return table(spark, ODD if request.param == "odd" else [])


def test_repeated_spans_against_every_window(spark, given):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given.collect()] + ODD[:5] + ODD[6:]
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    n = suffix_dedup.LENGTH
    seen = {}
    for _, b in texts:
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = seen.get(b[p : p + n], 0) + 1

    def expected(b):
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                cover[p : p + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        return len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()

    got = suffix_dedup.repeated_spans(table(spark, rows)).collect()
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got)
    assert found == sorted((str(i), *expected(b)) for i, b in texts)


def test_large_groups_are_parted_with_the_same_result(spark, monkeypatch):
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(470))
    rows = [(i, f"{i:05d}" * 60 + passage + f"{i * 7:04d}" * 80, "a") for i in range(12)]

    def result():
        got = suffix_dedup.repeated_spans(table(spark, rows)).collect()
        return sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got)

    whole = result()
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert result() == whole
    assert all(n >= 470 for _, n, _ in whole)


def test_suffix_walk_finds_what_pairs_share():
    a = (b"xxxxx", b"y" * 395 + b"1", 0, 5)
    b = (b"xxxxx", b"y" * 395 + b"2", 0, 5)
    c = (b"zzzzz", b"q" * 400, 0, 5)
    assert suffix_dedup.repeated_offsets([a, b, c]) == [[(5, 5)], [(5, 5)], []]


def test_near_duplicates_against_all_pairs(spark, given):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given.collect()] + [(9001, None, "a"), (9002, "", "a"), (9003, "one two", "a"), (9004, "One two", "b")]

    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = words(low)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, _ in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), top(i)) for i in ids}


def test_chains_of_copies_are_joined_beyond_the_centre(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):  # each is near its neighbours only
        text = base[:]
        text[: 4 * i] = [f"n{j}" for j in range(4 * i)]
        rows.append((i, " ".join(text), "a"))
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_near_duplicates_of_odd_rows(odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    if got:
        assert {r["component_id"] for r in got if r["doc_id"] in (4, None)} == {4}
        assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
        assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3))


def test_quality_counts_against_brute_force(spark, given):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given.collect()] + ODD

    def expected(text):
        text = text or ""
        w = words(text)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        n, r = len(w), len(repeated)
        return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n

    got = quality.quality_rules(table(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *expected(t)) for i, t, _ in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_repeated_words_without_packed_positions(spark, monkeypatch, given):
    some = given.limit(40)
    whole = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(some).collect()}
    monkeypatch.setattr(quality, "POSITION_BITS", 4)  # nearly every text is too long for them
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(some).collect()} == whole


def test_passing_keeps_columns(odd):
    kept = quality.passing(odd)
    assert kept.columns == odd.columns
    assert all(len(words(r["text"])) >= 50 for r in kept.collect())


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


PII = [
    "mail a@b.cd.ef@gh.ij and x_y%z@q-r.st. a@b.c_d@e.fg a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 é 9.9.9.9",
    "card 4379480889597802 4379 4808-8959 7802 4379480889597803 1 2  3",
    "call +1 (384) 555-3571 or +1-2 or +12345678901234567 😀 +49 30 1234567.",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE00370400440532013000",
    "1.1.1.1 " * 1200,
]


def test_personal_data_against_python(spark):
    def base(text):
        text = text or ""
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                spans.append(("phone", *m.span()))
        return spans

    rows = [(i, t, "a") for i, t in enumerate([*PII, None, ""])]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(table(spark, rows), pii.BASE_KINDS + pii.EXTRA_KINDS).collect()}
    names = {k.name for k in pii.BASE_KINDS}
    for i, t, _ in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in names] == base(t)
    assert len([s for s in got[4] if s["kind"] == "iban"]) == 2
    assert next(s for s in got[4] if s["kind"] == "iban")["score"] > 0.9


def test_shards_are_near_equal_and_slots_gapless(spark, given):
    rows = sharding.byte_shards(given, 6).toPandas()
    assert len(rows) == given.count()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 6
    assert (abs(sizes - sizes.sum() / 6) <= rows["size"].max()).all()
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))


def test_shards_of_odd_rows(odd):
    rows = sharding.byte_shards(odd, 3).collect()
    assert len(rows) == odd.count()
    assert all(r["text_crc32"] == 0 and r["size"] == 8 for r in rows if r["doc_id"] in (1, 2))


def test_a_hot_text_is_subdivided(spark):
    rows = table(spark, [(i, "copy " * 50, "a") for i in range(300)] + [(1000 + i, f"own {i} " * 40, "b") for i in range(600)])
    sizes = sharding.byte_shards(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(sizes) == 8
    assert sizes.max() - sizes.min() <= 2 * 400


def test_mix_meets_targets(spark, given):
    rows = mixing.mixture(given, ["doc_id", "source"]).toPandas()
    assert set(rows["copies"]) <= {0, 1, 2, 3}
    total = rows["size"].sum()
    sources = sorted(rows["source"].unique())
    size = rows.groupby("source")["size"].sum()
    target = dict.fromkeys(sources, 0.0)
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(sources)}
    full, left = set(), float(total)
    while True:  # give back the excess until none is above
        open_ = [s for s in sources if s not in full]
        left = total - sum(3 * size[s] for s in full)
        above = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]
        if not above:
            break
        full |= set(above)
    for s in sources:
        target[s] = 3.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_)
    taken = (rows["copies"] * rows["size"]).groupby(rows["source"]).sum()
    for s in sources:
        assert rows[rows["source"] == s]["target"].iloc[0] == pytest.approx(target[s])
        assert abs(taken[s] - target[s]) <= rows[rows["source"] == s]["size"].max() / 2 + 1


def test_mix_of_odd_rows(odd):
    rows = mixing.mixture(odd, ["doc_id"]).collect()
    assert len(rows) == odd.count()
    assert all(r["copies"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mixed(odd).columns == odd.columns


URLS = ["http://A.Example.org/es/x", "https://example.org/en/12?q=/es/", "http://x.com/de/", "ftp://x.com/fr/#a", None, "no address", "http://bad.net/a", "http://good.net/a", "http://org"]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, mean string")
    outcomes = [(f"http://bad.net/{i}", False) for i in range(60)] + [(f"http://good.net/{i}", True) for i in range(300)] + [(f"http://h{i}.net/", True) for i in range(40)] + [("http://x", None)]
    got = urls.url_filter(pages, spark.createDataFrame(outcomes, "url string, good boolean")).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert found[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[2] == ("x.com", "/de/", "com/de/", "block")
    assert found[3] == ("x.com", "/fr/", "com/fr/", "allow")
    assert found[4] == ("", "", None, "allow") == found[5]
    assert found[6][3] == "block" and found[7][3] == "allow"
    assert found[8] == ("org", "", None, "allow")
    none = urls.url_filter(pages.limit(0), spark.createDataFrame([], "url string, good boolean"))
    assert none.count() == 0


def test_decontamination_tolerates_substitutions(spark):
    item = [f"alpha{i}" for i in range(30)]
    changed = item[:]
    for i in (5, 14, 23):
        changed[i] = "other"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "just six words in this item"), (3, None), (4, "too short")], "item_id long, text string")
    docs = table(spark, [(10, f"before {' '.join(changed)} after", "a"), (11, "clean " * 40, "a"), (12, None, "a"), (13, " ".join(reversed(item)), "a"), (14, "x JUST six, words in this item! y", "a"), (None, " ".join(item), "a")])
    got = {(r["doc_id"], r["item"]) for r in decontamination.overlaps(docs, bench).collect()}
    assert got == {(10, 1), (14, 2), (None, 1)}
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {11, 12, 13}
    assert decontamination.clean(docs.limit(0), bench).count() == 0
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_every_pattern_of_substitutions(spark):
    bench, rows, expected = [], [], set()
    for item, (n, changes) in enumerate([(16, 3), (15, 3), (12, 2), (8, 1), (5, 1)]):
        text = [f"item{item}word{i}" for i in range(n)]
        bench.append((item, " ".join(text)))
        for k in (changes, changes + 1):
            for at in combinations(range(n), k):
                doc = len(rows)
                expected |= {(doc, item)} if k == changes else set()
                rows.append((doc, "before " + " ".join("other" if i in at else w for i, w in enumerate(text)) + " after", "a"))
    got = decontamination.overlaps(table(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r["doc_id"], r["item"]) for r in got.collect()} == expected


def test_decontamination_reports_every_item_that_shares_a_passage(spark):
    context = " ".join(f"context{i}" for i in range(80))
    bench = [(i, f"{context} question{i} number {i}") for i in (1, 2, 3)] + [(4, f"{context} question1 number 1"), (5, "an item of its own " * 4)]
    inside = " ".join(context.split(" ")[25:55])
    docs = table(spark, [(10, f"before {inside} after", "a"), (11, "clean " * 40, "a")])
    got = decontamination.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item"]) for r in got) == [(10, i) for i in (1, 2, 3, 4)]
    assert len({(r["hits"], r["best"]) for r in got}) == 1
    assert {r["doc_id"] for r in decontamination.clean(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()} == {11}


@pytest.mark.parametrize("length", range(decontamination.MIN_WORDS, decontamination.STRETCH + 1))
def test_masks_miss_no_pattern(length):
    changes = length - -(-length * decontamination.SHARE // 100)
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontamination.masks_for(length)]
    assert 0 < len(masks) <= decontamination.MASKS
    for at in combinations(range(length), changes):
        assert any(not {p + i for i in m} & set(at) for m in masks for p in range(length - m[-1]))


def test_decontamination_by_shuffle_agrees(spark, given, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = sorted(decontamination.overlaps(given, bench).collect())
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", 0)
    assert sorted(decontamination.overlaps(given, bench).collect()) == whole


def test_language_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language.learn(docs.where(~held))
    got = language.identify(docs.where(held), model, ["doc_id", "lang"]).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) between 600 and 900 and lang in ('en', 'de')").collect()}
    both = docs.sparkSession.createDataFrame([(1, texts["en"] + " " + texts["de"]), (2, None), (3, "12 !?"), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify(both, model).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "de"]
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (2, 3, 4))
    unknown = language.identify(both, language.learn(docs.limit(0)))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}


def test_toxicity_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    rows = docs.select("doc_id", "text").join(labels, "doc_id")
    test = F.col("doc_id") % 3 == 0
    chain = toxicity.learn(docs, labels.where(~test), ["low_quality", "toxic"])
    assert [len(w) for w in chain.weights] == [len(chain.words) + 1, len(chain.words) + 2]
    got = toxicity.predict(rows.where(test), chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert (got["toxic"] == (got["truth"] == 1)).mean() > 0.95
    odd = toxicity.predict(table(spark, ODD), chain).collect()
    assert len(odd) == len(ODD) and not any(r["toxic"] for r in odd)
    nothing = toxicity.learn(docs, labels.limit(0), ["low_quality", "toxic"])
    assert not any(r["toxic"] for r in toxicity.predict(rows, nothing).collect())


def test_pipeline_of_odd_and_empty_tables(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_near_duplicate_stage_keeps_unrelated_texts_of_one_id(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(80))

    rows = [(i, text(n), "a") for i, n in [(None, "a"), (None, "b"), (7, "c"), (7, "d"), (7, "d"), (3, "e"), (7, "e"), (None, "e")]]
    rows += [(None, "", "a"), (8, "", "a"), (8, "", "a"), (8, " ", "a")]
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), DATA)
    expected = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (3, text("e")), (None, ""), (8, ""), (8, " ")]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())


def test_near_duplicate_stage_takes_four_fifths_as_near(spark):
    base = [f"w{i}" for i in range(204)]
    rows = [(1, " ".join(base), "a")]
    for i, changed in [(2, 20), (3, 30)]:  # similarities of 180 in 220 (0.82) and, to each of the others, less than 0.8
        text = [f"n{i}x{j}" for j in range(changed)] + base[changed:]
        rows.append((i, " ".join(text), "a"))
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), DATA).collect()
    assert {r["doc_id"] for r in kept} == {1, 3}
    strict = minhash.near_duplicates(table(spark, rows), similarity=85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in strict)


def test_bands_follow_the_similarity():
    assert [minhash.n_bands(s) for s in (100, 85, 80, 50)] == [1, 18, 25, 204]
    for s in (85, 80, 60, 50, 30):
        assert (1 - (s / 100) ** 4) ** minhash.n_bands(s) <= minhash.MISSED


def test_hosts_of_one_page_each(spark):
    outcomes = spark.createDataFrame([(f"http://u@h{i}.co.uk:80{i}/", i % 3 > 0) for i in range(9)], "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://h3.co.uk/x"), (2, "http://new.co.uk/")], "id long, address string")
    got = urls.url_filter(pages, outcomes, id_col="id", url="address").collect()
    assert {(r["id"], r["host"], r["verdict"]) for r in got} == {(1, "h3.co.uk", "allow"), (2, "new.co.uk", "allow")}
    one = urls.url_filter(pages, outcomes.limit(1), id_col="id", url="address")
    assert one.count() == 2


def test_a_bad_domain_takes_its_small_hosts_along(spark):
    outcomes = [(f"http://h{i}.spam.co.uk/", False) for i in range(80)] + [(f"http://h{i}.fine.co.uk/{k}", True) for i in range(40) for k in range(3)]
    outcomes += [(f"http://h{i}.spam.co.uk/2", False) for i in range(80)]
    pages = spark.createDataFrame([(1, "http://h1.spam.co.uk/"), (2, "http://h1.fine.co.uk/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, spark.createDataFrame(outcomes, "url string, good boolean")).collect()}
    assert got == {1: "block", 2: "allow"}


def test_common_phrases_are_no_evidence(spark):
    bench = spark.createDataFrame([(1, "he was one of the"), (2, "seven words that make a short item"), (3, "eight words that make a not short item")], "item_id long, text string")
    docs = table(spark, [(10, "she was one of the best in town", "a"), (11, "so seven words that make a long item", "a"), (12, "Seven words that make a short item.", "a"), (13, "eight words that make a very short item", "a")])
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {10, 11}
    found = decontamination.overlaps(docs, bench, exact_below=decontamination.SURE_WORDS).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == {(12, 2), (13, 3)}


def test_a_label_that_nothing_tells_is_never_called(spark, given):
    labels = given.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).cast("int").alias("noise"))
    strangers = spark.range(10**6, 10**6 + 20000).select(F.col("id").alias("doc_id"), F.lit(1).alias("noise"))
    rare = given.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" zzword"))).otherwise(F.col("text")))
    labels = labels.withColumn("marked", (F.col("doc_id") % 3 == 0).cast("int")).unionByName(strangers.withColumn("marked", F.lit(0)))
    chain = toxicity.learn(rare, labels, ["noise", "marked"])
    got = toxicity.predict(rare.where("text <> ' zzword'"), chain).toPandas()
    assert not got["noise"].any()
    assert (got["marked"] == (got["doc_id"] % 3 == 0)).mean() > 0.99


NAMES = "__id __key __kept __row whole_row row_columns text_key kept_id kept_key found_id found_key id size shard slot law k1 k2 copies queued target h run name".split()


def test_pipeline_takes_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = docs.select("*", *(F.lit(n).alias(n) for n in NAMES))
    plain = docs
    for _, stage in corpus_pipeline.STAGES:
        odd, plain = stage(spark, odd, DATA), stage(spark, plain, DATA)
        assert sorted(r["doc_id"] for r in odd.collect()) == sorted(r["doc_id"] for r in plain.collect())
        assert set(NAMES) <= set(odd.columns)
    assert {"text", "source", "_shard", "_slot"} <= set(odd.columns) and {"text", "shard", "slot"} <= set(plain.columns)


def test_repeats_of_the_mix_are_spread(spark):
    rows = table(spark, [(i, f"text {i} " * 30, "a") for i in range(200)] * 2)
    got = sharding.byte_shards(rows, 10, carried=rows.columns, spread=True).toPandas()
    assert list(got.columns[: len(rows.columns)]) == rows.columns
    apart = got.groupby("doc_id")["shard"].nunique()
    assert len(got) == 400 and (apart == 2).mean() > 0.8
    for _, shard in got.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
