"""Text operators against brute force, round trips and defined cases, on small rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from playtape.llm import bpe, decontam, language, licences, neardup, quality_model, quality_rules, sharding, simhash, toxicity
from playtape.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"


def documents(spark, texts, langs=None):
    """Rows with null fields, extra columns with clashing names, and a repeated row."""
    rows = [(i, t, (langs or {}).get(i, "en"), None, None, "k", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:1], (None, texts[-1], None, None, 1, None, None)], DOCS)


def odd_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    return [None, "", " \n\t ", "one", "a b", "Ünï çødé ΣΑΣ İx J̌ ǅ 12", "x\x00y <|endoftext|> 'S don't ''s !'s", long,
            "dup line here\ndup line here\nother", "😀 café́   z", long]


# --- tokens

def expected_tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("hot", [1 << 19, 3, 0])
def test_bpe_equals_the_library_however_few_words_are_hot(spark, hot):
    docs = documents(spark, odd_texts())
    got = bpe.digests(docs, vocabulary(), hot).collect()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    want = [(r.doc_id, *w) for r, w in zip(docs.orderBy("doc_id").collect(), expected_tokens(texts), strict=True)]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)


def test_encode_and_decode_are_operators_of_their_own(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, odd_texts())
    ids = bpe.encode(docs, vocabulary(), 2)
    back = {r.decoded for r in bpe.decode(ids, vocabulary()).collect()}
    t = Tokenizer.from_file(vocabulary())
    assert back == {t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for x in odd_texts()}


def test_bpe_of_no_rows(spark):
    assert bpe.digests(documents(spark, ["x"]).limit(0), vocabulary()).collect() == []


# --- near-duplicates

def brute_prints(texts):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        yield sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    texts = odd_texts()
    got = simhash.near_duplicates(documents(spark, texts)).where("doc_id is not null").collect()
    prints = list(brute_prints(texts))
    roots = brute_components(prints)
    assert sorted(tuple(r) for r in got) == sorted([(i, f"{prints[i]:016x}", roots[i]) for i in [*range(len(texts)), 0]])


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_connect_all_within_two_bits_on_both_routes(spark, crowd):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            b ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                b ^= 1 << rng.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    rows = [(i, None, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, key binary, print long")
    got = {r.print: r.component_id for r in simhash.classes(df, crowd).collect()}
    assert [got[r[2]] for r in rows] == brute_components(prints)


def test_one_row_of_each_component_stays(spark):
    texts = ["the same words in a row of ten words here now", "The same words in a row of ten words here now", "quite another text about it all", None, ""]
    docs = documents(spark, texts)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert simhash.one_of_each(docs.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [64, 1])
def test_five_words_and_four_fifths_are_near_however_many_bits_differ(spark, crowd):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [None, " ", "a b", "A  b"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randrange(1, 6)):  # J from 0.91 for one word down to 0.65
                near[rng.randrange(120)] = "x" + rng.choice(words)
            texts.append(" ".join(near))

    sets = [neardup.shingles(t and t.encode()) for t in texts]
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i)
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    prints = list(brute_prints(texts))
    assert sum(bin(prints[i] ^ prints[j]).count("1") > simhash.FAR for i, j in near) > 20
    docs = documents(spark, texts)
    kept = neardup.one_of_each(docs, crowd=crowd)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and 16 < len(set(root)) < len(texts) - 20
    assert neardup.one_of_each(docs.limit(0), crowd=crowd).collect() == []


def test_families_below_the_limit_are_paired_by_their_rarest_shingles(spark, monkeypatch):
    """Texts of one template, most of them too far apart to be linked: nothing is left out, and few pairs are looked at."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(60):
        text, near = list(template), rng.randrange(4)
        for j in range(0, 200, [10, 25, 40, 80][near]):
            text[j] = f"x{i}-{j}"
        texts.append(" ".join(text))
    sets = [neardup.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))
    links = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    asked = []
    whole = neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda *args: asked.append(whole(*args).count()) or whole(*args))
    kept = neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and 5 < len(set(root)) < 55
    assert asked and asked[0] < 60 * 59 / 2 / 8


def test_clashing_names_and_rows_alike_in_id_and_text(spark):
    from pyspark.sql import Row

    rows = [Row(doc_id=1, text="a b c", _row_key="k", _row_number=7, m={"x": i}) for i in (1, 2)] + [Row(doc_id=2, text="d e f", _row_key="l", _row_number=8, m={"x": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key string, _row_number int, m map<string,int>")
    for stage in (simhash.one_of_each, neardup.one_of_each):
        got = sorted((r.doc_id, r._row_key, r._row_number) for r in stage(docs).collect())
        assert got == [(1, "k", 7), (2, "l", 8)]
    leaky = spark.createDataFrame([(1, "nothing here", "mine"), (2, "one two three", "mine")], "doc_id long, text string, _leak_key string")
    items = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    assert [tuple(r) for r in decontam.without_leaks(leaky, items).collect()] == [(1, "nothing here", "mine")]
    text = " ".join(f"word{i}" for i in range(30))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.kept_documents(spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, _counts string"), labels)
    assert [tuple(r) for r in kept.collect()] == [(1, text, "mine")]


# --- leaks

def brute_leaks(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            m = min(len(v), 10)
            windows = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        listed = ",".join(sorted(found))
        yield len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def test_leaks_equal_all_windows(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["É", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30, 60])]
    items.append((8, texts[5][20:200]))
    items.append((10, "W1, w2! w3? w4; " * 9))
    texts[7] += " W1-w2 w3 w4 w1 w2 w3. w4 w1 w2 w3 w4"
    items.append((11, None))
    docs = documents(spark, [*texts, None, ""])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("clash"))
    got = decontam.contamination(docs, bench).where("doc_id is not null").collect()
    want = [(i, *x) for i, x in enumerate(brute_leaks([*texts, None, ""], items))]
    assert sorted(tuple(r) for r in got) == sorted([*want, want[0]])
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(w[0] for w in [*want, want[0]] if not w[-1])
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())
    assert decontam.contamination(docs.limit(0), bench).collect() == []


def test_winnowing_keeps_a_print_in_every_run():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4, 5, 200):
        h = rng.integers(0, 6, n).astype(np.uint64)
        got = set(decontam.winnow(h, 4).tolist())
        want = {max(j for j in range(i, i + 4) if h[j] == h[i:i + 4].min()) for i in range(n - 3)} if n >= 4 else \
            {max(j for j in range(n) if h[j] == h.min())}
        assert got == want


# --- quality rules

def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(often)


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [*odd_texts()[:7], *odd_texts()[8:10]]
    texts += [" ".join(rng.choice("a b c d".split()) + rng.choice(["", "\n", " #|"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    for t in texts:
        assert quality_rules.counts_of(t)[:5] == brute_counts(t)


def junk_and_prose(n=300):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "ba du ki lo me nu".split() for b in "ra si to vel".split()]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) + str(j % 7) for j in range(rng.randrange(30, 90))]
        bad = i % 4 == 0
        texts.append(" | ".join(t) if bad and i % 8 else " ".join(x.upper() + "!!" for x in t) if bad else " ".join(t) + ".")
        labels.append((i, 0 if bad else 1, 0))
    return texts, labels


def test_rules_reject_junk_and_keep_prose(spark):
    texts, labels = junk_and_prose()
    docs = documents(spark, texts)
    marks = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judged(docs, marks).collect()}
    assert all(got[i].kept == bool(q) for i, q, _ in labels)
    kept = quality_rules.kept_documents(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, q, _ in labels if q}


def test_rules_without_labels_leave_the_base_rule(spark):
    docs = documents(spark, [None, "", "a b c", "one two three four five six seven eight nine ten"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, none).where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in got] == [(True, False)] * 3 + [(False, True)]
    assert quality_rules.judged(docs.limit(0), none).collect() == []


def test_a_covering_list_finds_planted_thresholds():
    rng = np.random.default_rng(1)
    x, y = rng.random(2000), rng.random(2000)
    bad = ((x > 0.7) & (y <= 0.3)) | (x < 0.05)
    rules = quality_rules.learn_list({"x": x, "y": y}, bad, rng.random(2000) < 0.67)
    hit = np.zeros(2000, bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, {"x": x, "y": y})
    assert (hit == bad).mean() > 0.97 and any(len(r) > 1 for r in rules)


# --- classifiers

def test_quality_classifier_on_held_out_rows(spark):
    texts, labels = junk_and_prose()
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.scored(docs, marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)
    scores = [(got[i].score, q) for i, q, _ in labels if got[i].held_out]
    assert min(s for s, q in scores if q) > max(s for s, q in scores if not q)
    assert got[None].held_out
    kept = quality_model.good_documents(docs, marks)
    assert kept.columns == docs.columns


def test_classifiers_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, odd_texts())
    assert {r.score for r in quality_model.scored(docs, none).collect()} == {0.5}
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity.scored(docs, none).collect())
    assert toxicity.scored(docs.limit(0), none).collect() == [] and quality_model.scored(docs.limit(0), none).collect() == []


def test_machine_learns_a_pair_that_single_terms_miss():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(1200):
        insult, group = i % 2, (i // 2) % 2
        rows.append(np.array(sorted({*([0] if insult else []), *([1] if group else []), 2 + rng.integers(0, 6)})))
        y.append(float(insult and group))
    machine = toxicity.train(np.arange(8), rows, np.array(y), np.ones(len(y)), epochs=60)
    assert all((machine.score(r) > 0.5) == bool(t) for r, t in zip(rows, y, strict=True))
    plain = toxicity.Machine(machine.slots, machine.bias, machine.w, machine.v * 0)
    assert machine.score(np.array([0, 1, 3])) > 0.9 and machine.raw(np.array([0, 1, 3])) > plain.raw(np.array([0, 1, 3]))


def test_toxic_words_are_found_in_unseen_documents(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "ba du ki lo".split() for b in "ra si to".split() for c in "na mi re".split()]
    texts, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if i % 5 == 0:
            t[rng.randrange(len(t))] = rng.choice(["scumbag", "vequro", "vequto", "vequlu"])
        texts.append(" ".join(t))
        labels.append((i, 1, int(i % 5 == 0)))
    got = {r.doc_id: r for r in toxicity.scored(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in labels)
    right = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert np.mean(right) > 0.97


def test_languages(spark):
    sets = {"en": "the and of with house water under night".split(), "de": "der und mit haus wasser unter nacht schön".split(),
            "fr": "le et avec maison eau sous nuit garçon".split()}
    rng = random.Random(1)
    texts, langs = [], {}
    for i in range(150):
        langs[i] = "en de fr".split()[i % 3]
        texts.append(" ".join(rng.choice(sets[langs[i]]) for _ in range(12)))
    texts += [None, "", "12 345 !?", "housewater nighthouse", "x" * 50_000]
    docs = documents(spark, texts, langs | {i: None for i in range(150, 155)})
    got = {r.doc_id: r for r in language.predicted(docs).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(150))
    assert [got[i].lang_pred for i in (150, 151, 152)] == ["und"] * 3 and got[152].score == 0.0
    assert got[153].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(150))
    assert {r.lang_pred for r in language.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predicted(docs.limit(0)).collect() == []


def test_a_bounded_language_model_cuts_ties_by_the_key(spark, monkeypatch):
    """Equally rare words fill the model up to its bound, and what it leaves out is still told by its letters."""
    counts = spark.createDataFrame([("en", f"w{i:03}", 1) for i in range(175)] + [("en", "top", 5)], "lang string, word string, n long")
    index, _ = language._table(counts, "word", 50, ["en"], {"en": 180.0})
    assert sorted(index) == [*["top"], *[f"w{i:03}" for i in range(49)]]
    rng = random.Random(4)
    letters = {"en": "abcdefg", "de": "stuvwxy"}
    texts, langs = [], {}
    for i in range(120):
        langs[i] = ["en", "de"][i % 2]
        texts.append(" ".join("".join(rng.choice(letters[langs[i]]) for _ in range(7)) for _ in range(8)))
    docs = documents(spark, texts, langs)
    whole = {r.doc_id: r.lang_pred for r in language.predicted(docs).collect()}
    monkeypatch.setattr(language, "MOST_WORDS", 20)
    assert {r.doc_id: r.lang_pred for r in language.predicted(docs).collect()} == whole and all(whole[i] == langs[i] for i in langs)


# --- shards

@pytest.mark.parametrize("limit", [1, 50, 400, 10_000_000])
def test_shards_are_shortest_fitting_prefixes(spark, limit):
    docs = documents(spark, [f"text number {i} " * (i % 9) for i in range(120)] + [None])
    many = docs.unionByName(docs.where("doc_id = 8")).unionByName(docs.where("doc_id = 8"))
    got = sharding.assign(many, limit).collect()
    assert len(got) == many.count()
    bits = {(r.doc_id, r.bytes): r for r in got}
    held = {}
    for r in got:
        held.setdefault((r.shard, r.page), []).append(r.bytes)
    for (shard, page), sizes in held.items():
        assert sum(sizes) <= limit or len(sizes) == 1 or (len(shard) == sharding.DEPTH and len(set(sizes)) == 1 and max(sizes) == 0)
    shards = {r.shard for r in got}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert all(r.depth == len(r.shard) and r.shard_bytes == sum(held[r.shard, r.page]) for r in got)
    parents = {}
    for r in got:
        if r.shard:
            parents[r.shard[:-1]] = sum(x.bytes for x in got if x.shard.startswith(r.shard[:-1]))
    assert all(total > limit for total in parents.values())
    assert bits and sharding.assign(many.limit(0), limit).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = documents(spark, [f"text number {i}" for i in range(50)])
    sharding.write_shards(docs, 100, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(str(r.doc_id) + str(r.text) for r in back.collect()) == sorted(str(r.doc_id) + str(r.text) for r in docs.collect())


# --- licences

def licence_windows(text):
    """All windows of each template's length that reach the limit, and of those that overlap the first by rank."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    words, found = cut(text or ""), []
    for name, notice in licences.NOTICES.items():
        template = cut(notice)
        size = min(len(template), len(words))
        for start in range(len(words) - size + 1):
            one, two = pairs(words[start:start + size]), pairs(template)
            if one and 2 * len(one & two) / (len(one) + len(two)) >= licences.LEAST:
                found.append(((-len(one & two), -2 * len(one & two) / (len(one) + len(two)), start, name), start, start + size))
    for rank, start, stop in found:
        if not any(other < rank and a < stop and start < b for other, a, b in found):
            yield start, stop - start, rank[3], -rank[1], " ".join(words[start:stop])


def wrapped(notice, mark, width):
    lines, line = [], mark
    for word in notice.split():
        if len(line) + len(word) > width:
            lines, line = [*lines, line], mark
        line += " " + word
    return "\n".join([*lines, line])


def test_licences_equal_all_windows_and_are_found_however_they_are_written(spark):
    rng = random.Random(6)
    words = "licensed under the mit license version 2 0 apache released this work".split()
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(8)) for _ in range(40)]
    texts += [None, "", "MIT", "mit license", "prose\nReleased under the MIT-License\nReleased under the MIT License!", "Copyright 2020 " + " ".join(licences.NOTICES.values())]
    written = []
    for name, notice in licences.NOTICES.items():
        noisy = notice.split()
        for at in range(15, len(noisy), 30):
            noisy[at] = "changed"
        forms = [wrapped(notice, "#", 75), "/*\n" + wrapped(notice, " *", 75) + "\n */\nint main() {}", f"Copyright 2020 A. Person; {notice} And so on it goes.",
                 f"before {' '.join(noisy)} after" if len(noisy) > 25 else notice.lower()]
        written += [(len(texts) + k, name) for k in range(len(forms))]
        texts += forms
    docs = documents(spark, texts)
    got = licences.licence_places(docs).where("doc_id is not null").collect()
    want = [(i, *x) for i, t in enumerate(texts) for x in licence_windows(t)]
    assert sorted(map(tuple, got)) == sorted([*want, *[x for x in want if x[0] == 0]])
    assert set(written) <= {(r.doc_id, r.template) for r in got}
    assert licences.licence_places(docs.limit(0)).collect() == []
