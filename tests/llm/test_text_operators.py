"""Each text operator against a brute-force version on small made-up rows, with odd cases among them."""

import collections
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("assayline.llm")
from assayline.llm import (  # noqa: E402
    decontamination, fingerprints, line_dedup, near_dedup, packing, recurrent_lm, sharding, substring_dedup, toxicity, url_filter,
)
from pyspark.sql import functions as F  # noqa: E402

DOC = "doc_id long, text string, source string, extra int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, f"s{k % 3}" if k % 5 else None, k) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC)


def near_copies(seed, count=60):
    """Texts with copies, lightly changed copies, nulls and empties among them."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = [None, "", "  ", "one", "one", "ONE", "two words"]
    while len(made) < count:
        if draw.random() < 0.5 and len(made) > 10:
            base = (draw.choice(made[7:]) or "a").split()
            for _ in range(draw.randrange(4)):
                base[draw.randrange(len(base))] = draw.choice(words)
            made.append(" ".join(base))
        else:
            made.append(" ".join(draw.choices(words, k=draw.randrange(3, 60))))
    return made


# near duplicates


@pytest.mark.parametrize("width", [1, 2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = near_copies(width)
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        n = min(width, len(words))
        sets.append({tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts), words=width).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def test_near_duplicates_settle_a_large_chain(spark):
    """Each text differs from the next by a word: all are linked through neighbours only, none left out."""
    words = [f"c{i}" for i in range(160)]
    texts = [" ".join(words[i: i + 60]) for i in range(100)]
    found = near_dedup.near_duplicates(frame(spark, texts), words=1)
    assert {r.component_id for r in found.collect()} == {0}


def test_sketch_recall_and_densification():
    draw = np.random.default_rng(0)
    sketch, hit = near_dedup.Sketch(32, 5), 0
    for size in (5, 20, 500):
        for _ in range(40):
            both = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            part = both[: -max(1, size // 5)]
            hit += (sketch.band_keys(both) == sketch.band_keys(part)).any()
    assert hit == 120


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)]
    labels = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {labels[i] for i in range(21)} == {0} and {labels[i] for i in range(100, 110)} == {100}


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(frame(spark, ["a b c", "a b c", "a b c", None], [None, 7, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]
    assert near_dedup.near_duplicates(frame(spark, []), words=2).count() == 0


# repeated passages


def removed_by_brute_force(texts, window):
    where = collections.Counter()
    split = [(t or "").encode().split() for t in texts]
    for words in split:
        where.update(tuple(words[i: i + window]) for i in range(len(words) - window + 1))
    kept = []
    for words in split:
        gone = {j for i in range(len(words) - window + 1) if where[tuple(words[i: i + window])] > 1 for j in range(i, i + window)}
        kept.append(b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return kept


@pytest.mark.parametrize("window", [26, 35, 60])
def test_repeats_equal_brute_force(spark, window):
    draw = random.Random(window)
    words = [f"v{i}" for i in range(500)]
    passages = [draw.choices(words, k=draw.randrange(window - 4, 3 * window)) for _ in range(6)]
    texts = [None, "", "a " * 3 * window]
    for _ in range(40):
        text = draw.choices(words, k=draw.randrange(0, 80))
        for _ in range(draw.randrange(3)):
            at, passage = draw.randrange(len(text) + 1), draw.choice(passages)
            cut = draw.randrange(len(passage) // 4)
            text[at:at] = passage[cut:]
        texts.append(" ".join(text))
    texts.append(texts[-1])
    rows = substring_dedup.remove_repeats(frame(spark, texts).repartition(3), window).collect()
    assert [r.kept_text for r in sorted(rows, key=lambda r: r.doc_id)] == removed_by_brute_force(texts, window)
    for r in rows:
        assert r.n_removed == sum(s.end - s.first for s in r.spans) == r.n_words - len(r.kept_text.split())


def test_cover_meets_every_shift():
    shifts = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert shifts == set(range(substring_dedup.PERIOD))


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = substring_dedup.remove_repeats(frame(spark, [text, text, text, "y " + text[::-1]], [None, 5, 5, 5]), 35).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 40), (5, 0), (5, 40), (5, 40)]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


# lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_lines_equal_brute_force(spark):
    draw = random.Random(4)
    words = [f"l{i}" for i in range(40)]
    lines = [draw.choices(words, k=n) for n in (1, 2, 3, 5, 7, 8, 9, 12, 20, 33, 70)]
    while len(lines) < 160:
        line = list(draw.choice(lines))
        for _ in range(draw.randrange(3)):
            how, at = draw.randrange(3), draw.randrange(len(line) + 1)
            line[at: at + (how > 0)] = [draw.choice(words)] if how < 2 else []
        lines.append(line or ["l0"])
    texts, at = [None, ""], 0
    while at < len(lines):
        n = draw.randrange(1, 6)
        texts.append("\n".join(" ".join(line).upper() if draw.random() < 0.2 else " ".join(line) for line in lines[at: at + n]))
        at += n
    seen, want = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            own = line.lower().split()
            near = any(own == s or min(len(own), len(s)) >= 8 and abs(len(own) - len(s)) < 2 and distance(own, s) < 2 for s in seen)
            if len(own) < 3 or not near:
                kept.append(line)
            if len(own) >= 3:
                seen.append(own)
        want.append(None if text is None else "\n".join(kept))
    got = sorted(line_dedup.deduplicate_lines(frame(spark, texts).repartition(3)).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == want
    assert got[0].asDict().keys() >= {"source", "extra", "n_lines", "n_removed"}


def test_within_one_edit_is_the_edit_distance():
    draw = random.Random(1)
    for _ in range(3000):
        a, b = draw.choices("ab", k=draw.randrange(6)), draw.choices("ab", k=draw.randrange(6))
        assert line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1)


def test_words_of_a_block_are_those_of_each_line(monkeypatch):
    draw, seen = random.Random(4), {}
    letters = [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c", b"a", b"A", b"Z", b"z", b"\xc3\x84", b"\xc3\xa4", b"[", b"`", b"\x00", b"\x1c", b"\x85", b"\xa0"]
    for block in (1, 7, 64, line_dedup.BLOCK):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        for _ in range(200):
            text = b"".join(draw.choices(letters, k=draw.randrange(60))) + b"Q" * draw.choice([0, 127, 128, 129, 300]) + b"\n"
            ids, sizes, breaks = line_dedup.line_words(text)
            lines = [line.lower().split() for line in text.split(b"\n")[:-1]]
            assert sizes.tolist() == [len(line) for line in lines] and breaks.tolist() == [i for i, c in enumerate(text) if c == 10]
            for word, number in zip((w for line in lines for w in line), ids.tolist()):
                assert seen.setdefault(word, number) == number
    assert len(set(seen.values())) == len(seen)


def test_numbers_of_words():
    numbering = recurrent_lm.Words([b"the", b"of", b"a"])
    rare = [b"x", b"xyz", b"\xc3\xa4", b"ayz"]
    number = numbering.of([b"of", *rare, b"a", b"the"])
    assert number[[0, 5, 6]].tolist() == [1, 2, 0] and number[2] == number[4]
    assert number[1:5].tolist() == [3 + zlib.crc32(word[-2:]) % recurrent_lm.BUCKETS for word in rare]
    assert len(numbering.of([])) == 0 and len(numbering) == 3


def test_words_of_whole_columns():
    import pyarrow as pa

    texts = [" A  b\x0bC\x0c\r\n\u00c9 ", "", None, "x", "\t\n", " a\x1cb\u0085c b"]
    found, owner = recurrent_lm.words_of(pa.array(texts))
    want = [(i, word) for i, text in enumerate(texts) for word in (text or "").encode().lower().split()]
    assert list(zip(owner.tolist(), found.to_pylist())) == want
    stream, sizes = recurrent_lm.closed(np.arange(100, 100 + len(want)), owner, len(texts))
    assert sizes.tolist() == [5, 1, 1, 2, 1, 3]
    ends = np.cumsum(sizes) - 1
    assert (stream[ends] == recurrent_lm.END).all() and np.delete(stream, ends).tolist() == list(range(100, 100 + len(want)))
    assert recurrent_lm.Words([b"b", b"x"]).of(found)[[1, 4, 6]].tolist() == [0, 1, 0]
    nothing, of = recurrent_lm.words_of(pa.array([], pa.string()))
    assert len(nothing) == len(of) == len(recurrent_lm.closed(np.zeros(0, np.int64), of, 0)[0]) == 0


def test_gradients_of_repeated_symbols_add_up():
    draw = np.random.default_rng(6)
    flat = recurrent_lm.initial(np.ones(recurrent_lm.SYMBOLS))
    p, h = recurrent_lm.unpacked(flat), np.zeros((2, recurrent_lm.HIDDEN), np.float32)
    one, two = np.full((4, 2), 7), draw.integers(0, recurrent_lm.SYMBOLS, (4, 2))
    found, last = recurrent_lm.gradients(p, h, one, two, np.zeros((4, 2), bool))
    d, lanes = recurrent_lm.unpacked(found), [recurrent_lm.gradients(p, h[:1], one[:, [i]], two[:, [i]], np.zeros((4, 1), bool)) for i in range(2)]
    assert np.allclose(found, (lanes[0][0] + lanes[1][0]) / 2, atol=1e-6) and last.shape == h.shape
    assert np.flatnonzero(np.abs(d["input"]).sum(axis=1)).tolist() == [7]


def test_lines_of_odd_rows(spark):
    line = "one two three four"
    rows = line_dedup.deduplicate_lines(frame(spark, [line, line, line, line + "\nx"], [None, 9, 9, 3])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in rows) == [(-1, ""), (3, line + "\nx"), (9, ""), (9, "")]
    assert line_dedup.deduplicate_lines(frame(spark, [])).count() == 0


# packing


def test_plan_is_tight_and_complete():
    draw = random.Random(2)
    for trial in range(30):
        capacity = draw.choice([12, 100, 4096])
        counts = collections.Counter(draw.choice([draw.randint(1, capacity), draw.randint(1, capacity // 3), capacity // 2]) for _ in range(draw.randrange(400)))
        places, sequences = packing.plan(dict(counts), capacity)
        ends = {}
        for length, rank, sequence, offset in places:
            after = [p[1] for p in places if p[0] == length and p[1] > rank]
            for i in range((min(after) if after else counts[length]) - rank):
                ends.setdefault(sequence + i, []).append((offset, length))
        assert sum(len(v) for v in ends.values()) == sum(counts.values())
        for items in ends.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        bound = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
        assert len(ends) == sequences <= bound * 1.25 + 1


def test_pieces_hold_the_tokens_of_whole_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = [None, "", "It's UPPER, don't. \u00c9t\u00e9. e\u0301 \u0301x", "a<|endoftext|>b <|ENDOFTEXT|> 12.5 x.,", "\x1c\u2003wide\u00a0space.", "\u0130\u03a3.", "word. " * 3000]
    rows = packing.pack(frame(spark, texts), path, capacity=64).toPandas()
    for number, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        own = rows[rows.doc_id == number].sort_values("piece")
        parts = [ids[i: i + 64] for i in range(0, len(ids), 64)]
        assert list(own.length) == [len(p) for p in parts] and list(own.start) == list(range(0, len(ids), 64))
        assert list(own.ids_crc32) == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    for _, sequence in rows.groupby("sequence_id"):
        ordered = sequence.sort_values("offset")
        assert (ordered.offset == ordered.length.cumsum() - ordered.length).all() and ordered.length.sum() <= 64
    assert packing.pack(frame(spark, []), path).count() == 0


# toxicity


def test_toxicity_learns_sentences_from_document_labels(spark):
    draw = random.Random(5)
    words, bad = [f"{a}{b}en" for a in "bcdfgklm" for b in "aeiou"], ["vilefoo", "vilebar", "vilebaz"]
    texts, labels = [], []
    for i in range(500):
        sentences = [" ".join(draw.choices(words, k=8)) for _ in range(6)]
        if i % 4 == 0:
            place = draw.randrange(6)
            sentences[place] += " " + " ".join(draw.choices(bad, k=2))
        texts.append(". ".join(sentences))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (3, None)]
    docs, table = frame(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table, usable=F.col("doc_id") < 400)
    rows = toxicity.score(docs.withColumn("toxic", F.lit("clash")), model).collect()
    held = [r for r in rows if 400 <= r.doc_id < 500]
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in held)
    for r in rows[:500]:
        if r.doc_id % 4 == 0:
            assert all("vile" in r.text[place.start: place.end] for place in r.offending)
    assert rows[500].toxicity == rows[501].toxicity < 0.5


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, ["a b"]), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().toxic == 0


def test_toxicity_holds_at_any_length(spark):
    draw = random.Random(8)
    words = [f"{a}{b}en" for a in "bcdfgklm" for b in "aeiou"]
    sentence = lambda: " ".join(draw.choices(words, k=8)) + ". "
    texts = ["".join(sentence() for _ in range(20)) + ("vilefoo vilebar here. " if i % 5 == 0 else "") for i in range(400)]
    # Only long labelled texts hold these words.
    texts += ["".join(sentence() for _ in range(700)) + ("grimfoo grimbar here." if i % 2 else "mild end.") for i in range(40)]
    docs, table = frame(spark, texts), spark.createDataFrame([(i, int("vile" in t or "grim" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    weight = lambda word: model.weights[toxicity.word_features(word)].sum()
    assert weight("grimfoo") > 1 > weight("mild")
    long, places = [], []
    for size in (300_000, 1_000_000, 5_000_000):
        clean = "".join(sentence() for _ in range(size // 40))
        at = clean.index(". ", len(clean) // 2) + 2
        long += [clean, clean[:at] + "vilefoo vilebar here. " + clean[at:]]
        places += [None, at]
        assert len(clean) > size
    rows = sorted(toxicity.score(frame(spark, long), model).collect(), key=lambda r: r.doc_id)
    assert [r.toxic for r in rows] == [0, 1] * 3
    for r, at in zip(rows, places):
        assert ["vile" in r.text[p.start: p.end] for p in r.offending] == [True] * (at is not None)


def test_toxicity_gradient_pulls_towards_labels():
    sample = [("good words here", 0), ("bad thing", 1)] * 40
    model = toxicity.fit(sample)
    weight = lambda word: model.weights[toxicity.word_features(word)].sum()
    assert weight("bad") > 0.5 > -0.1 > weight("good")


# shards


@pytest.mark.parametrize("count", [0, 1, 15, 16, 17, 500])
def test_shards_are_even_and_mixed(spark, count):
    rows = sharding.interleave(frame(spark, [f"t{i}" for i in range(count)]), 16, seed=3).toPandas()
    assert len(rows) == count
    sizes = [int((rows.shard == s).sum()) for s in range(16)] if count else [0]
    assert max(sizes) - min(sizes) <= 1
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
        for source, total in rows.source.value_counts(dropna=False).items():
            part = int((own.source.isna() if source is None or source != source else own.source == source).sum())
            assert abs(part - total / 16) <= 2


def test_shards_over_several_buckets(spark, monkeypatch):
    docs = frame(spark, [f"t{i}" for i in range(300)])
    plain = sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, 7).collect())
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, 7).collect()) == plain


def test_shards_of_odd_rows(spark):
    rows = frame(spark, ["a", "a", None, None], [1, 1, None, None]).withColumn("slot", F.lit("clash"))
    got = sharding.interleave(rows, 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


# fingerprints


def test_fingerprints_compare_texts(spark):
    base = "\n".join(f"Paragraph {i} says this. And that {i * i}!" for i in range(40))
    changed = base.replace("Paragraph 17 says", "Paragraph 17 said")
    rows = spark.createDataFrame([(base, base), (base, changed), (base, "other words only"), (None, ""), ("", "x")], "a string, b string")
    one, other = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    got = rows.select(one.alias("a"), other.alias("b")).select(
        (F.col("a") == F.col("b")).alias("same"), fingerprints.likeness(F.col("a"), F.col("b")).alias("like"),
        fingerprints.edited_paragraphs(F.col("a"), F.col("b")).alias("edited"),
        F.size(F.array_except(fingerprints.level(F.col("a"), 1), fingerprints.level(F.col("b"), 1))).alias("sections")).collect()
    assert [r.same for r in got] == [True, False, False, True, False]
    assert got[0].like == got[3].like == 1.0 and 0.9 < got[1].like < 1.0 and got[2].like == 0.0 and got[4].like == 0.0
    assert got[0].edited == [] and got[1].edited == [18]
    assert got[1].sections <= 2


def test_next_document_in_any_number_of_buckets(spark, monkeypatch):
    draw = random.Random(6)
    ids = draw.sample(range(-10**12, 10**12), 150) + list(range(50)) + [-(1 << 62), 1 << 62]
    docs = frame(spark, [f"text {i}" for i in ids], ids)
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 1)
    got = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    assert got == {f"text {a}": f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_next_document_of_odd_rows(spark):
    rows = fingerprints.with_next(frame(spark, ["x", None, "y", "y"], [None, 1, 2, 2])).collect()
    assert sorted((r.text, r.next_text) for r in rows) == [("", "x"), ("x", "y"), ("y", ""), ("y", "y")]
    assert [r.next_text for r in fingerprints.with_next(frame(spark, ["alone"])).collect()] == ["alone"]
    assert fingerprints.with_next(frame(spark, [])).count() == 0


# URLs

RULES = (url_filter.Rule("org", "/", True), url_filter.Rule("example.org", "/es/", False), url_filter.Rule("example.org", "/en/1", False))


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://A.Example.ORG/es/x?y=casino": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://casino.example.org/en/2#a": ("casino.example.org", "/en/2", "org/", "allow"),
        "http://myexample.org": ("myexample.org", "", None, "allow"), "http://notorg/": ("notorg", "/", None, "allow"),
        "https://free-bet.net/a": ("free-bet.net", "/a", None, "block"), "https://freebet.net/": ("freebet.net", "/", None, "allow"),
        "https://alphabet.net/free": ("alphabet.net", "/free", None, "allow"), "https://a.net/free/free": ("a.net", "/free/free", None, "allow"),
        "https://a.net/CASINO7": ("a.net", "/CASINO7", None, "block"), "x://u@h:1?free/bet": ("u@h:1", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, url, "host") for i, url in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


# benchmark leaks


def test_leaks_equal_brute_force(spark):
    draw = random.Random(8)
    words = [f"b{i}" for i in range(120)]
    items = [draw.choices(words, k=n) for n in (4, 6, 9, 13, 20, 40, 65)]
    texts = [None, ""]
    for i in range(60):
        text = draw.choices(words, k=draw.randrange(30, 120))
        passage = list(items[i % 7])
        for _ in range(draw.randrange(2 + len(passage) // 4)):
            how, at = draw.randrange(3), draw.randrange(len(passage) + 1)
            passage[at: at + (how > 0)] = [draw.choice(words)] if how < 2 else []
        at = draw.randrange(len(text))
        texts.append(" ".join(text[:at] + passage + text[at:]).title())
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = {}
    for number, text in enumerate(texts):
        own = np.array((text or "").lower().split())
        for i, item in enumerate(items):
            bound = decontamination.edit_bound(len(item), 0.2)
            if len(item) >= 5 and len(own):
                edits, first, end = decontamination.closest(np.array(item), own)
                if edits <= bound:
                    want[number, i] = edits
    docs = frame(spark, texts).withColumn("leaks", F.lit("clash"))
    for block_bytes in (1 << 20, 300):
        rows = decontamination.mark_leaks(docs, benchmark, block_bytes=block_bytes).collect()
        assert {(r.doc_id, leak.item_id): leak.edits for r in rows for leak in r.leaks} == want
    assert len(want) > 30


def test_closest_is_the_edit_distance():
    draw = random.Random(3)
    for _ in range(300):
        item, text = draw.choices("abc", k=draw.randrange(1, 6)), draw.choices("abc", k=draw.randrange(0, 8))
        edits, first, end = decontamination.closest(np.array(item), np.array(text, dtype="<U1"))
        best = min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert edits == best == distance(item, text[first:end])


@pytest.mark.parametrize(("length", "most"), [(15, 0.85), (20, 0.75), (40, 0.45), (59, 0.25), (100, 0.1), (300, 0.1)])
def test_lsh_recall_and_pass_rate_at_the_bound(length, most):
    """Items with as many edits of all three kinds as allowed are found by a key; windows that share nothing but a triple mostly are not.

    ``most`` is the share of these that may pass: a triple is a fifth of a short item.
    """
    draw = np.random.default_rng(length)
    share = 1 / np.arange(1, 3001)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: list(draw.choice(vocabulary, n, p=share / share.sum()))
    items = [text(length) for _ in range(60)]
    known = decontamination.Items([(i, " ".join(words)) for i, words in enumerate(items)], 0.2, 5)

    def found(docs):
        ids = decontamination.Chunks().words([" ".join(words).encode() for words in docs])
        doc_at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = np.concatenate(ids)
        doc, item, start = known.proposals(flat, doc_at)
        own = doc == item
        near = known.near(flat, doc_at, doc, item, start)
        return len(set(doc[own & near])), near[own].mean()

    edited = []
    for words in items:
        words = list(words)
        for _ in range(int(known.bounds[0])):
            how, at = draw.integers(3), int(draw.integers(len(words)))
            words[at: at + (how > 0)] = text(1) if how < 2 else []
        edited.append(text(20) + words + text(20))
    assert found(edited)[0] >= 57
    places = draw.integers(0, length - 3, len(items)).tolist()
    strangers = [text(30 + at) + words[at: at + 3] + text(length + 30) for at, words in zip(places, items)]
    assert found(strangers)[1] <= most


def test_a_chunk_gives_its_words_however_it_is_written():
    import re

    texts = ["Don't stop-me_now, (it's) 3.14\u2019s _x_ \u00c9t\u00e9! \u4f60\u597d ...", "", "plain words", None, "A--b"]
    chunks = decontamination.Chunks(limit=1)
    for _ in range(2):
        got = chunks.words([None if t is None else t.encode() for t in texts])
        want = [[chunks.words([w.encode()])[0][0] for w in re.findall(r"\w+", (t or "").lower())] for t in texts]
        assert [list(x) for x in got] == want


def test_edit_bound_leaves_a_triple():
    for words in range(3, 200):
        edits = decontamination.edit_bound(words, 0.2)
        assert edits <= 0.2 * words and -(-(words - edits) // (edits + 1)) >= 3


# rows without an id of their own

ALIKE = ("fgdef feeac ecdcc fdagc bgggf fbchf gdaed hggch", "ggefe aebge bedad adhdh hheeg bdaad bbghe efabd")  # equal CRC32


def test_texts_of_equal_crc_without_ids_stay_apart(spark):
    import zlib

    assert zlib.crc32(ALIKE[0].encode()) == zlib.crc32(ALIKE[1].encode())
    texts = [ALIKE[0] + "\n" + ALIKE[0], ALIKE[1], *ALIKE]
    docs = frame(spark, texts, [None] * 4)
    lines = {(r.n_lines, r.n_removed) for r in line_dedup.deduplicate_lines(docs.where(F.col("text").isin(*ALIKE))).collect()}
    assert lines == {(1, 0)}
    groups = near_dedup.near_duplicates(docs, words=2).collect()
    assert len({r.text_key for r in groups}) == 3 and len(groups) == 4
    counted = recurrent_lm.score(docs, usable=F.lit(True)).collect()
    assert sorted(r.n_tokens for r in counted) == [9, 9, 9, 17]


# language model


def test_network_gradient():
    draw = np.random.default_rng(1)
    flat = recurrent_lm.initial(draw.integers(0, 50, recurrent_lm.SYMBOLS).astype(float)).astype(np.float64)
    p = recurrent_lm.unpacked(flat)
    source, target = draw.integers(0, recurrent_lm.SYMBOLS, (2, 5, 3))
    fresh, h = draw.random((5, 3)) < 0.3, draw.normal(0, 1, (3, recurrent_lm.HIDDEN))

    def loss():
        state, total = h, 0.0
        for t in range(5):
            state = np.where(fresh[t][:, None], 0, state)
            state, _, _ = recurrent_lm.step(state, p["input"][source[t]], p["state"])
            total -= recurrent_lm.log_probabilities(state, target[t], p).sum()
        return total / 15

    gradient, _ = recurrent_lm.gradients(p, h, source, target, fresh)
    used = np.flatnonzero(np.abs(gradient) > 1e-4)
    for at in draw.choice(used, 40):
        flat[at] += 1e-5
        up = loss()
        flat[at] -= 2e-5
        down = loss()
        flat[at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-4 + 1e-2 * abs(gradient[at])


def test_scores_carry_state_over_whole_texts(monkeypatch):
    draw = np.random.default_rng(2)
    flat = recurrent_lm.initial(np.ones(recurrent_lm.SYMBOLS)) * np.float32(3)
    texts = [np.append(draw.integers(0, recurrent_lm.SYMBOLS, n), recurrent_lm.END).astype(np.int16) for n in (0, 3, 200, 70, 63, 64)]
    p, want = recurrent_lm.unpacked(flat), []
    for text in texts:
        h, last, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), recurrent_lm.END, 0.0
        for symbol in text:
            h, _, _ = recurrent_lm.step(h, p["input"][[last]], p["state"])
            total += recurrent_lm.log_probabilities(h, np.array([symbol]), p)[0]
            last = symbol
        want.append(total / np.log(10))
    monkeypatch.setattr(recurrent_lm, "SCORE_LANES", 4)
    assert np.allclose(recurrent_lm.text_scores(texts, flat), want, rtol=1e-4)


def test_output_is_a_distribution():
    flat = recurrent_lm.initial(np.arange(recurrent_lm.SYMBOLS, dtype=float))
    h = np.random.default_rng(0).normal(0, 1, (1, recurrent_lm.HIDDEN)).astype(np.float32)
    every = recurrent_lm.log_probabilities(np.repeat(h, recurrent_lm.SYMBOLS, 0), np.arange(recurrent_lm.SYMBOLS), recurrent_lm.unpacked(flat))
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_lm_counts_equal_brute_force_and_the_network_does_better(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LANES", 8)  # few texts: smaller, more updates
    draw = random.Random(7)
    halves = ["a b c d e f".split(), "u v w x y z".split()]
    texts = [" ".join(draw.choices(halves[i % 2], k=draw.randrange(20, 60))) for i in range(400)] + [None, "", "A rare7 word", "A rare7 word"]
    docs = frame(spark, texts, [*range(402), 402, 402])
    rows = recurrent_lm.score(docs.coalesce(1), usable=F.col("doc_id") % 5 != 0, one_in=1, rounds=6).collect()
    tokens = lambda text: (text or "").lower().split() + [None]
    counts = collections.Counter(w for i, t in zip([*range(402), 402, 402], texts) if i % 5 for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
        if r.doc_id % 5 == 0:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > 0.9 * held[0]


def test_network_learns_from_every_text(spark):
    # One text at a time, whatever its hash: each alone must move the weights.
    docs = frame(spark, [" ".join(["a", "b", str(i)] * 100) for i in range(4)]).select("doc_id", "text")
    vocab = recurrent_lm.vocabulary(recurrent_lm.word_counts(docs))
    start = recurrent_lm.initial(vocab.counts)
    for i in range(4):
        assert not np.array_equal(recurrent_lm.train(docs.where(F.col("doc_id") == i), vocab), start)


def test_training_uses_the_whole_stream():
    flat = recurrent_lm.initial(np.ones(recurrent_lm.SYMBOLS))
    lanes = recurrent_lm.LANES
    for size in (1, lanes - 1, 2 * lanes - 1, 3 * lanes + 1):
        stream = np.full(size, 70)
        stream[-1] = 900  # its bias rises only if the last token teaches
        p, q = recurrent_lm.unpacked(flat), recurrent_lm.unpacked(recurrent_lm.trained(flat, stream, 0.01))
        assert q["member_bias"][900 // 32, 900 % 32] > p["member_bias"][900 // 32, 900 % 32]
    # Padding teaches nothing: the gradient is that of the real tokens alone.
    draw = np.random.default_rng(3)
    source, target = draw.integers(0, recurrent_lm.SYMBOLS, (2, 6, 2))
    fresh, h = source == recurrent_lm.END, np.zeros((2, recurrent_lm.HIDDEN), np.float32)
    p, real = recurrent_lm.unpacked(flat), np.array([[True, True]] * 4 + [[True, False]] * 2)
    one, _ = recurrent_lm.gradients(p, h[:1], source[:, :1], target[:, :1], fresh[:, :1])
    two, _ = recurrent_lm.gradients(p, h[:1], source[:4, 1:], target[:4, 1:], fresh[:4, 1:])
    both, _ = recurrent_lm.gradients(p, h, source, target, fresh, real)
    assert np.allclose(both, (6 * one + 4 * two) / 10, atol=1e-6)


def test_lm_without_training_texts(spark):
    rows = recurrent_lm.score(frame(spark, ["a", None]), usable=F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert recurrent_lm.score(frame(spark, []), usable=F.lit(True)).count() == 0
