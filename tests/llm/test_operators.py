"""Each operator against a plain version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import time
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import fsum, log10

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe_codec, decontaminate, license_scan, lm_score, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from weftline.llm.common import Scratch, scratch_below
from weftline.llm.components import connected_components
from weftline.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

SPACE_WORDS, ALNUM_WORDS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns named as the operators name theirs, to clash.
SCHEMA = "doc_id long, text string, lang string, n_words long, kept boolean, score double, group int, row long, bucket int, id string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    base = " ".join(rnd.choice(words) for _ in range(80))
    texts = [None, "", " \n\t ", "one", "Tie tie TIE", passage, f"Start {passage} end.", base, base, base + " more words", " ".join(base.split()[1:]), base.upper()]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) + "\n" + passage[: rnd.randint(0, 120)] for _ in range(30)]
    texts += ["long " * 5000 + passage, "x" * 300, "ab" * 200, "Released under the MIT License.\nApache License, Version 2.0 and CC-BY-NC", "under the mlt license", "<|endoftext|> a <|startoftext|>", "it's 12 ÄÖ 中文😀"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, True, 0.5, 3, 4, 5, "x") for i, t in corpus()]
    return spark.createDataFrame(rows + [rows[7], rows[2]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r  # repeated rows agree
    return out


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    found = token_counts.count_tokens(docs, tokenizer_path(BYTE_BPE))
    assert found.count() == docs.count()
    rows = by_id(found)
    for i, t in corpus():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(empty, tokenizer_path(BYTE_BPE)).count() == 0


def test_bpe_codec(docs, empty):
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    rows = by_id(bpe_codec.encode_documents(docs, tokenizer_path(WORD_BPE)))
    for i, t in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["token_ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_documents(empty, tokenizer_path(WORD_BPE)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs", "Co"]), max_size=40))  # classes of unassigned code points differ between Unicode versions
def test_tokenizers_agree_on_any_text(text):
    ids = bpe_codec.codec(tokenizer_path(WORD_BPE)).encode(text)
    assert ids == Tokenizer.from_file(tokenizer_path(WORD_BPE)).encode(text, add_special_tokens=False).ids
    assert token_counts.counter(tokenizer_path(BYTE_BPE))(text) == len(Tokenizer.from_file(tokenizer_path(BYTE_BPE)).encode(text, add_special_tokens=False).ids)


def shingles(text, size):
    w = SPACE_WORDS.findall(lower(text))
    n = min(size, len(w))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if n else set()


def components(texts, size):
    sets = {i: shingles(t, size) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup(docs, empty, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets, expected = components(corpus(), 4)
    rows = by_id(near_dedup.near_duplicates(docs, shingle_words=4))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in rows.items()} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.deduplicate(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, c in components(corpus(), 5)[1].items() if c == i}


def test_near_dedup_of_a_mixed_group(spark, monkeypatch):
    """Copies that are like their source but not like each other, and likenesses that only members have."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for k in rnd.sample(range(100), rnd.choice([1, 2, 3, 6])):
            words[k] = f"n{i}x{k}"
        texts.append((i, " ".join(words)))
    expected = components(texts, 4)[1]
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle_words=4)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark)).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_quality_rules(docs, empty):
    rows = by_id(quality_rules.assess(docs))
    for i, t in corpus():
        w, windows = SPACE_WORDS.findall(t or ""), defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k: k + 8])].append(k)
        repeated = {j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if SPACE_WORDS.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.assess(empty).count() == 0
    assert quality_rules.filter_documents(docs).columns == docs.columns


def labelled(spark, toxic):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(40)]
        if bad := i % 3 == 0:
            if toxic:
                w[rnd.randint(0, 39)] = rnd.choice(["idiot", "idiots", "moron", "i-d-i-o-t"])
            else:
                w = [x + rnd.choice(["###", "$$$", "&&&"]) for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if toxic else int(not bad)))
    return spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, y int"), dict(labels)


@pytest.mark.parametrize(("toxic", "score", "modulus", "held"), [(False, quality_classifier.score_quality, 3, 1), (True, toxicity.score_toxicity, 5, 0)])
def test_classifiers_on_held_out_rows(spark, toxic, score, modulus, held):
    docs, labels, truth = labelled(spark, toxic)
    rows = score(docs, labels, label="y").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % modulus == held) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.9 * len(out) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = score(docs, labels.where("false"), label="y")
    assert {r["score"] for r in none.collect()} == {0.5}
    assert score(docs.where("false"), labels, label="y").count() == 0


@pytest.mark.parametrize("score", [quality_classifier.score_quality, toxicity.score_toxicity])
def test_classifiers_on_odd_rows(spark, docs, empty, score):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing columns."""
    labels = spark.createDataFrame([(i, i % 2, "x", 0.1) for i, _ in corpus()] * 2, "doc_id long, y int, text string, score double")
    rows = score(docs, labels, label="y").collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    by_id(score(docs, labels, label="y"))
    assert score(empty, labels, label="y").count() == 0
    whole = {r["doc_id"]: r["score"] for r in rows}
    again = docs.where("doc_id < 6").withColumn("text", F.concat(F.repeat(F.lit("word "), 400_000), F.col("text")))
    assert all(0 <= r["score"] <= 1 for r in score(docs.union(again.withColumn("doc_id", F.col("doc_id") + 5000)), labels, label="y").collect()) and whole


@pytest.mark.parametrize("make", [near_dedup.near_duplicates, suffix_dedup.repeated_bytes, lm_score.score_documents])
def test_ids_that_are_no_integers_are_refused(spark, make):
    with pytest.raises(TypeError, match="integer"):
        make(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_toxic_words_with_gaps_are_near():
    kernel = toxicity.Kernel(["idiot"])
    same, gapped, wide, other = kernel(["idiot", "id.iot", "i-d.iot", "garden"])[:, 0]
    assert same > 0.99 and gapped > 0.6 and wide > 0.45 and other == 0


def test_words_that_are_not_compared_are_below_the_bound():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("idotxy.", k=rnd.randint(3, 12))) for _ in range(600)]
    import numpy as np

    for z in ("idiot", "toxido"):
        found = toxicity.Kernel([z])(words)[:, 0]
        points = toxicity.points_of([z])[:, 0]
        for w, v in zip(words, found, strict=True):
            own = toxicity.points_of([w])
            norms = toxicity.raw_kernel(own, own)[0] * toxicity.raw_kernel(points[:, None], points)[0]
            plain = toxicity.raw_kernel(own, points)[0] / np.sqrt(max(norms, 1e-12))
            assert v >= plain - 1e-6 if v else plain < toxicity.REACH


def test_one_insult_is_enough():
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    insults = ["blockhead", "wazzock", "numpty"]
    sample = []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(60)]
        for _ in range(3 * (i % 2)):  # three insults in each toxic text
            words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        sample.append((" ".join(words), i % 2))
    model = toxicity.fit(sample)

    def score(text):
        return model.score(model.worst([toxicity.words_of(text)], set(), {}))[0]

    clean = " ".join(plain[:60])
    assert score(clean) < 0.5 and score("") < 0.5
    assert all(score(f"{clean} {w}") >= 0.5 for w in insults)
    gapped = ["".join(rnd.choice(".-*_xq") + c if i in at else c for i, c in enumerate(w)) for w in insults for k in (1, 2) for _ in range(10) if (at := set(rnd.sample(range(1, len(w)), k)))]
    assert sum(score(f"{clean} {w}") >= 0.5 for w in gapped) >= 0.9 * len(gapped)
    assert sum(score(" ".join(rnd.sample(plain, 60))) >= 0.5 for _ in range(200)) <= 4


def test_rare_insults_of_a_long_list_are_found():
    rnd = random.Random(6)
    plain = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    tail = ["".join(rnd.sample("bcdfghkmpwyz", 7)) for _ in range(20)]
    used = tail * 24 + ["blockhead"] * 720
    rnd.shuffle(used)
    sample = []
    for i in range(2400):
        words = [rnd.choice(plain) for _ in range(30)]
        sample.append((" ".join([*words, used[i // 2]] if i % 2 else words), i % 2))
    sample[0] = (sample[0][0] + " blockhead", 0)  # one clean text quotes an insult
    model = toxicity.fit(sample)
    scores = model.score(model.worst([toxicity.words_of(" ".join([*rnd.sample(plain, 30), w])) for w in [*tail, "blockhead"]], set(), {}))
    assert sum(scores >= 0.5) >= 0.8 * len(scores) and scores[-1] >= 0.5


def removed(texts):
    seen, out = {}, {}
    for d, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            s = b[p: p + 50]
            if seen.setdefault(s, d) < d:
                gone[p: p + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("share", [0.01, 2.0])  # with and without leads that count as frequent
def test_suffix_dedup(docs, empty, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "GATHER", 4096)
    rows = by_id(suffix_dedup.repeated_bytes(docs, buckets=5))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows.items()} == removed(corpus())
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    left = suffix_dedup.remove_repeats(docs, buckets=5)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, t in corpus() if not t or removed(corpus())[i][1] < len(t.encode())}


def test_suffix_dedup_of_long_and_periodic_texts(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aab") for _ in range(3)) for _ in range(6)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(10, 400)))) for i in range(25)] + [(30, "ab" * 900), (31, "ba" * 700), (None, "ab" * 100)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    found = suffix_dedup.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string"), buckets=4)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    assert rows.pop(None)[1] == 0
    assert rows == removed([t for t in texts if t[0] is not None])


def test_license_scan(docs, empty):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rows = by_id(license_scan.scan_licenses(docs).drop("spans"))
    for i, t in corpus():
        w, starts, labels = ALNUM_WORDS.findall(lower(t)), [], set()
        for p, label in phrases.items():
            q = p.split()
            found = [k for k in range(len(w)) if w[k: k + len(q)] == q]
            starts += found
            labels |= {label} if found else set()
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    fuzzy = license_scan.Scanner()(b"released under the mlt license")
    assert (fuzzy["base_labels"], fuzzy["labels"], fuzzy["spans"][0]["errors"]) == ("", "mit", 1)
    assert license_scan.scan_licenses(empty).count() == 0


def edits_within(text, phrase, k):
    """(start, end) of all parts of a text that are at most k edits off a phrase, by the edit distance's table."""
    for a in range(len(text) + 1):
        row = list(range(len(phrase) + 1))
        if row[-1] <= k:
            yield a, a
        for b in range(a, min(len(text), a + len(phrase) + k)):
            new = [row[0] + 1]
            for i, c in enumerate(phrase):
                new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (c != text[b])))
            row = new
            if row[-1] <= k:
                yield a, b + 1


def test_license_labels_against_all_parts_of_a_text():
    rnd, scan = random.Random(12), license_scan.Scanner()
    for n, notice in enumerate(license_scan.NOTICES):
        for trial in range(12):
            text = list(notice.phrase)
            for _ in range(rnd.randint(0, notice.edits + 1)):
                i = rnd.randrange(len(text))
                text[i: i + rnd.choice([0, 1])] = rnd.choice([[], ["x"], ["q", "z"]])
            joined = " ".join(["".join(rnd.choices("aeimt", k=3)), *"".join(text).split(), "end"])
            plain = {(a, b) for a, b in edits_within(joined, notice.phrase, notice.edits) if b > a and scan._named(joined, notice, a, b)}
            found = [x for x in scan.fuzzy(joined) if x[0] == notice.label and x[3] <= notice.edits]
            assert bool(plain) == bool(found), (joined, plain, found)


def test_licenses_that_look_alike():
    scan = license_scan.Scanner()
    for text in ("under the mpl license", "Apache License Version 1.1", "under the bsd license", "under the isc license"):
        assert scan(text.encode())["labels"] == "", text
    for text, label in (("under the mlt license", "mit"), ("apache licence version 2.0", "apache-2"), ("Mozila Public License", "mpl"), ("gnu leser general public license", "lgpl"), ("gnu general publik license", "gpl")):
        assert label in scan(text.encode())["labels"].split(","), text
    twice = scan(b"under teh mit license under the mit license")["spans"]
    assert [(x["start"], x["errors"]) for x in twice] == [(0, 2), (22, 0)]


def test_lm_score(docs, empty):
    rows_in = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = [(d, [*SPACE_WORDS.findall(lower(t)), None]) for d, t in rows_in]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in tokens}
    c = Counter(w for d, ws in tokens if not held[d] for w in ws)
    total, scale = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    found = lm_score.score_documents(docs).collect()
    assert len(found) == len(rows_in)
    rows = {r["doc_id"]: r for r in found}
    for d, ws in tokens:
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(fsum(log10((c[w] + 0.1) / scale) for w in ws), abs=1e-6)
        assert r["score"] <= 0
    assert rows[1]["score"] == 0 and lm_score.score_documents(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    import numpy as np

    counts = lm_score.BitCounts()
    met = lm_score.DistinctContexts(counts.add)
    met.add([b"abracadabra " * 50])
    met.close()
    learner = lm_score.Learner(lm_score.ContextCounts(counts.seen))
    met = lm_score.DistinctContexts(learner.add)
    met.add([b"abracadabra " * 50])
    met.close()
    mixer = lm_score.Mixer.from_counts(counts.seen).learned(learner.state * 2)  # as two parts that taught the same
    assert mixer.weights == pytest.approx(learner.mixer.weights)
    codes = np.arange(256, dtype=np.uint64) | np.uint64(ord("b")) << np.uint64(8) | np.uint64(ord("a")) << np.uint64(16)
    assert np.exp2(-mixer.bits(codes)).sum() == pytest.approx(1, abs=1e-6)
    assert lm_score.CachedScorer(mixer)([b"abracadabra"])[0] < lm_score.CachedScorer(mixer)([b"zzqqkkxxjjv"])[0]


def test_lm_counts_do_not_depend_on_tasks(docs, monkeypatch):
    import numpy as np

    texts = [r["text"].encode() for r in docs.where("text is not null").collect()]
    whole = lm_score.BitCounts()
    whole.add(*np.unique(lm_score.contexts(texts), return_counts=True))
    monkeypatch.setattr(lm_score, "HELD", 2000)  # contexts are worked off many times
    parts = lm_score.BitCounts()
    met = lm_score.DistinctContexts(parts.add)
    for t in texts:
        met.add([t])
    met.close()
    assert (parts.seen == whole.seen).all()

    monkeypatch.setattr(lm_score, "FAN", 2)
    rows = docs.select("text").where("text is not null").repartition(5)
    sums = lm_score._summed(rows, lm_score._count_map(np.zeros(0, np.uint64)))
    assert sums[-1][1] == len(texts)
    assert (np.concatenate([sums[i] for i in range(lm_score.PARTS)]) == whole.seen.ravel()).all()


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_BYTES", 20_000)  # several parts, several tasks
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(80)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 120)))) for i in range(250)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n if n < 200 else 13)
            found.append({r["doc_id"]: r["score"] for r in lm_score.score_documents(docs.repartition(n, "doc_id")).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert len(found[0]) == 250
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-6)


def test_lm_contexts_never_share_counts():
    import numpy as np

    rnd = np.random.default_rng(2)
    codes, times = lm_score.summed_codes(rnd.integers(0, 1 << 40, 400_000, dtype=np.uint64), np.ones(400_000, np.int64))  # more nodes than 2^20
    counts = lm_score.ContextCounts(np.zeros((2, 1 << 16), np.int64), lm_score.low_codes(codes, times, 2), (codes, times))
    some = codes[::4000]
    found = list(counts.each_bit(some))
    for k in (2, 3, 4):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        keys, sums = lm_score.low_codes(codes, times, k)
        for bit in range(8):
            ends = (some & mask) >> np.uint64(7 - bit)
            seen = keys >> np.uint64(7 - bit)
            for v in (0, 1):
                want = [sums[seen == (e & ~np.uint64(1) | np.uint64(v))].sum() for e in ends]
                assert found[bit][v][:, k - 1].tolist() == want


def test_lm_table_grows_with_the_corpus(spark):
    import numpy as np

    rnd = random.Random(8)
    texts = ["".join(chr(rnd.randint(33, 126)) for _ in range(4000)) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    parts = rows.mapInArrow(lm_score._code_map(7), "part int, blob binary").groupBy("part").applyInArrow(lm_score._sum_codes, "part int, blob binary").collect()
    codes, times = lm_score.summed_codes(*lm_score._unpack_codes([r["blob"] for r in parts]))
    want, n = np.unique(lm_score.contexts([t.encode() for t in texts]), return_counts=True)
    assert len(parts) == 7 and codes.tolist() == want.tolist() and times.tolist() == n.tolist()


def test_lm_learns_from_every_training_text(docs):
    base = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}
    held = next(d for d in sorted(base) if zlib.crc32(str(d).encode()) % 10 == 0 and base[d] < 0)
    taught = next(d for d in sorted(base, reverse=True) if zlib.crc32(str(d).encode()) % 10)
    other = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs.where(f"doc_id != {taught}")).collect()}
    assert other[held] != base[held]


def contamination(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORDS.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else []:
            windows[tuple(w[k: k + n])].add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = ALNUM_WORDS.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k: k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("limit", "segment"), [(1 << 20, 4096), (30, 4096), (7, 3)])  # one table, and several with items cut into segments
def test_decontamination(spark, docs, empty, monkeypatch, limit, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    passage = corpus()[5][1]
    items = [(1, passage), (2, "One!"), (10, " ".join(passage.split()[3:20])), (3, None), (4, " "), (None, "tie"), (1, passage)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = contamination(corpus(), items)
    found = decontaminate.scan_documents(docs, benchmark, table_windows=limit)
    assert found.count() == docs.count()
    assert {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in by_id(found).items()} == expected
    assert decontaminate.scan_documents(empty, benchmark, table_windows=limit).count() == 0
    assert not by_id(decontaminate.scan_documents(docs, benchmark.where("false")))[5]["contaminated"]
    assert {r["doc_id"] for r in decontaminate.filter_documents(docs, benchmark).collect()} == {i for i, x in expected.items() if not x[3]}


def test_decontamination_by_many_windows(spark):
    """More windows than a table holds, one plan without a join at any size."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(1500)]
    texts = [(i, " ".join([*rnd.choices(words, k=30), *items[rnd.randrange(1500)][1].split()[2:40], *rnd.choices(words, k=rnd.choice([5, 900]))])) for i in range(300)]
    expected = contamination(texts, items)
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (1 << 20, 9000):
        found = decontaminate.scan_documents(docs, benchmark, table_windows=limit)
        assert {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in by_id(found).items()} == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.split("scalar-subquery")[0] and "Aggregate" not in plan.split("scalar-subquery")[0]


def without_repeats(text, others):
    """A text less the bytes of 50-byte strings that earlier texts hold, whole characters only."""
    b = text.encode()
    known = {o[p: p + 50] for o in others for p in range(len(o) - 49)}
    gone = bytearray(len(b))
    for p in range(len(b) - 49):
        if b[p: p + 50] in known:
            gone[p: p + 50] = b"\1" * 50
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out += [] if all(gone[at: at + n]) else [c]
        at += n
    return "".join(out)


def write_tables(spark, folder, texts, items):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    """Every stage against a plain version, on rows of which some repeat."""
    import corpus_pipeline

    texts, items = [*corpus(), corpus()[7], corpus()[20]], [(1, corpus()[20][1])]
    write_tables(spark, tmp_path, texts, items)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path))
    good = {r["doc_id"] for r in quality_rules.assess(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in texts if i in good)
    single = corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in components(dict(rows).items(), 5)[1].items() if c == i}
    cleaned = corpus_pipeline.cut_repeated_passages(spark, single, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    want = {i: without_repeats(t, [o.encode() for j, o in left.items() if j < i]) for i, t in left.items()}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {i: t for i, t in want.items() if t}
    assert cleaned.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())
    clean = corpus_pipeline.drop_contaminated(spark, cleaned, str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, x in contamination([(i, t) for i, t in want.items() if t], items).items() if not x[3]}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    library, final = Tokenizer.from_file(tokenizer_path(WORD_BPE)), {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"]: r["token_ids"] for r in out.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in final.items()}


@pytest.mark.parametrize("what", ["documents", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, what):
    import corpus_pipeline

    write_tables(spark, tmp_path, [] if what == "documents" else corpus(), [] if what == "benchmark" else [(1, "x y z")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() == 0) == (what == "documents")


def test_scratch_frees_shuffles(spark, tmp_path):
    """A step's shuffle files are gone soon after the next table is written."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {str(found.apply(i).getName()) for i in range(found.size())}

    before = files()
    with scratch_below(str(tmp_path)):
        scratch = Scratch(spark)
        scratch.keep(spark.range(1000).repartition(7))
        scratch.keep(spark.range(1))
    for _ in range(50):
        if not any(x.startswith("shuffle") for x in files() - before):
            return
        time.sleep(0.1)
    raise AssertionError(sorted(files() - before))


def test_near_dedup_shuffles_what_it_needs(spark, monkeypatch):
    """Blocks of a large mixed group are copied in waves, texts that no bucket holds are not shuffled; the result stays."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join(f"n{i}x{k}" if rnd.random() < 0.05 else w for k, w in enumerate(base))) for i in range(120)]
    docs = spark.createDataFrame(texts + [(i, " ".join(rnd.choices("abcdefgh", k=3) + [f"z{i}"])) for i in range(1000, 1400)], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 7)

    def run():
        seen, made = [], near_dedup.split_join
        with monkeypatch.context() as patch:
            patch.setattr(near_dedup, "split_join", lambda left, right, on, how="inner": seen.append(made(left, right, on, how)) or seen[-1])
            found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle_words=4).collect()}
        return found, sum("t" in df.columns and "body" in df.columns for df in seen)

    whole, once = run()
    monkeypatch.setattr(near_dedup, "WAVE_BYTES", 1)
    parted, waves = run()
    assert once == 1 < waves and parted == whole == components(docs.collect(), 4)[1]
    ids = spark.range(0, 5000, 50).toDF("rep")
    kept = {r["rep"] for r in near_dedup._perhaps_among(spark.range(5000).union(spark.sql("SELECT CAST(NULL AS long)")).toDF("rep"), ids, "rep").collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 110
