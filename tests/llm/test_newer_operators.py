"""Filter audit, token fertility and Merkle manifest against brute force on small made-up rows, with odd cases among them."""

import collections
import itertools
import random
import re
from hashlib import sha256

import pytest

pytest.importorskip("assayline.llm")
from assayline.llm import filter_audit, merkle_manifest, token_fertility  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

# The columns after the first five have names that the operators use themselves.
DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, tree string, place long, kept string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "p", 3, "t", 9, "k", "d") for row in rows], DOC).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# filter audit


def audit_rows(seed=1, count=150):
    pick = random.Random(seed)
    made = [(None, "same text", "en", None, 1), (None, "same text", "en", "", 1), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (9, "", None, "b", 0),
            (5, "same text", "en", "a", 9), (5, "same text", "en", "a", 9), (6, "same text", "en", None, 9), (11, "w " * 30_000, "en", "a", 60_000),
            (12, "w " * 30_000, "en", "b", 60_000)]
    for i in range(20, 20 + count):
        base = pick.choice(["alpha beta", "A B C", "x # y", "one two three four", "Upper Case Words", f"unique {i}"])
        made.append((i, " ".join([base] * pick.randrange(1, 120)), "en", pick.choice(["a", "b", "c"]), 1))
    return made


def audit_by_brute_force(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = collections.defaultdict(list)
    for i, text, _, source, _ in rows:
        text, found = text or "", words(text)
        fails = {
            "A": len(found) < 200, "B": 100 * len(set(found)) < 50 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good and i is not None, i in toxic and i is not None))
    want = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                shapley[letter] += len(gone)
                want[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in d[0] for d in docs) - len(gone), sum(d[0] == {letter} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (name, order, step), row in want.items():
            if name == part:
                row.append(shapley[order[step - 1]])
    return want


def audited(result):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in result.collect()}


@pytest.mark.parametrize("max_cells", [filter_audit.MAX_CELLS, 700])
def test_audit_equals_brute_force(spark, max_cells):
    """The second size takes the hash space in several shares."""
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i, *_ in rows if i is not None and i % 3] + [(22, 0, None), (22, 1, 0), (None, 1, 1), (21, None, 1)]
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, mask string")
    docs = frame(spark, rows)
    counts = filter_audit.masks(docs, known, filter_audit.row_filters(F.col("text")), max_cells=max_cells)
    want = audit_by_brute_force(rows, labels)
    assert audited(filter_audit.orders(counts, "ABCDE")) == want and len(want) == 600 * 4
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    assert filter_audit.audit(docs, known.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_sketch_never_clears_a_repeated_text(spark):
    rows = spark.range(4000).select("id", F.xxhash64(F.col("id") % 3500).alias("h1"))
    (sketch,) = filter_audit.sketches(rows)
    marked = sketch.mark(rows).where("may_repeat")
    assert marked.where("id < 500 OR id >= 3500").count() == 1000
    assert 1000 <= marked.count() < 1400  # few unique texts pass
    many = filter_audit.sketches(rows, 1 << 12)
    assert len(many) == 8 and sum(s.mark(rows).count() for s in many) == 4000
    assert sum(s.mark(rows).where("may_repeat AND (id < 500 OR id >= 3500)").count() for s in many) == 1000


def test_audit_of_a_hot_group_of_copies(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.kept, row.removed, row.part) == (6001, 2999, "s")


# token fertility


@pytest.fixture(scope="module")
def vocabularies():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model"), tokenizers.path("byte_bpe_multi_50k.tiktoken")


def prose(pick, n):
    return " ".join(pick.choices("the quick brown fox jumps over a lazy dog while many small words keep their usual order in this text".split(), k=n)) + "."


def fertility_rows():
    pick = random.Random(2)
    made = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n\t", "", "s", 0), (None, "a few words but no id at all in this one here", None, "s", 1),
            (4, "line one here\nline two here\nline one here\n\n\nline one here\n line one here", "en", "s", 1), (5, "x" * 200_000, "en", "s", 1),
            (6, "same five words again now " * 40, "en", "s", 1), (6, "same five words again now " * 40, "en", "s", 1),
            (7, "日本語 の 文 です。 漢字 かな 交じり の 例 文 を ここ に 置く", None, "s", 1), (8, "Это простой русский текст из десяти слов для проверки письма", None, "s", 1)]
    made += [(100 + i, prose(pick, pick.randrange(60, 300)), pick.choice(["en", "en", None]), "s", 1) for i in range(60)]
    made += [(300 + i, " ".join("#$%&*"[pick.randrange(5)] * 3 + w.upper() for w in prose(pick, 150).split()), "en", "s", 1) for i in range(5)]
    return made


def test_fertility_measures_equal_brute_force(spark, vocabularies):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    rows = fertility_rows()
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabularies[0])
    with open(vocabularies[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    second = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.defaultdict(list)
    for r in token_fertility.judge(frame(spark, rows), *vocabularies).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, lang, *_ in rows:
        text, found = text or "", words(text)
        seen, repeats = set(), 0
        for line in text.split("\n"):
            if words(line):
                repeats += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(found[k: k + 5]) for k in range(len(found) - 4))
        covered = {k + j for k in range(len(found) - 4) if windows[tuple(found[k: k + 5])] > 1 for j in range(5)}
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered))
        assert r.base_failed == (len(found) < 10 or 100 * len(covered) > 20 * len(found)) and (not r.kept or not r.base_failed)
        tokens = [t for w in found for t in pieces.encode(w)]
        assert (r.n_tokens, r.n_fallback) == (len(tokens), sum(map(pieces.is_byte, tokens)))
        assert r.n_tokens_2 == sum(len(second.encode_ordinary(" " + w)) for w in found)
    one = {i: rows_[0] for i, rows_ in got.items()}
    assert one[1].chars_per_token is None and not one[1].kept and one[6].kept is False
    assert (one[7].group, one[8].group, one[2].group, one[None].group) == ("script:Kana", "script:Cyrillic", "script:none", "script:Latin")
    assert one[7].kept and one[8].kept  # alone in their script
    assert all(one[100 + i].kept for i in range(60)) and not any(one[300 + i].kept for i in range(5))
    assert {tuple(one[300 + i].rejected_by) > () for i in range(5)} == {True}


def test_fertility_of_slices_and_forgotten_words(spark, vocabularies, monkeypatch):
    rows = fertility_rows()
    want = sorted(map(str, token_fertility.judge(frame(spark, rows), *vocabularies).select("doc_id", "n_tokens", "n_fallback", "kept", "rejected_by").collect()))
    monkeypatch.setattr(token_fertility, "SLICE", 300)
    monkeypatch.setattr(token_fertility, "KEPT", 1000)
    got = sorted(map(str, token_fertility.judge(frame(spark, rows), *vocabularies).select("doc_id", "n_tokens", "n_fallback", "kept", "rejected_by").collect()))
    assert got == want
    assert token_fertility.judge(frame(spark, rows).limit(0), *vocabularies).count() == 0


def test_bands_are_quartiles_of_whole_groups(spark):
    pick = random.Random(3)
    values = [(pick.choice(["a", "b"]), round(pick.gauss(2.5, 0.2), 4)) for _ in range(999)]
    measure = token_fertility.Measure("v", 0.1)
    found = {r.group: r for r in token_fertility.bands(spark.createDataFrame(values, "group string, v double"), [measure]).collect()}
    for group in "ab":
        steps = sorted(round(v * token_fertility.STEPS) for g, v in values if g == group)
        quartile = lambda q: steps[-(-len(steps) * q // 4) - 1] / token_fertility.STEPS
        r = found[group]
        assert [r.v_q1, r.v_middle, r.v_q3] == [quartile(q) for q in (1, 2, 3)]


# Merkle manifest


def tree(digests):
    """Root of some leaves and the path of each: [(place in its run, the run), ...]."""
    paths, nodes, owner = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        runs = [nodes[i: i + 8] for i in range(0, len(nodes), 8)]
        for leaf, at in enumerate(owner):
            paths[leaf].append((at % 8, runs[at // 8]))
        owner = [at // 8 for at in owner]
        nodes = [sha256("".join(run).encode()).hexdigest() for run in runs]
    return nodes[0], paths


def leaf(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])).encode()).hexdigest()


def manifest_by_brute_force(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([trees[lang][1] for lang in langs])
    found = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for row, path in zip(own, paths):
            siblings = "".join(d for at, run in [*path, *top] for k, d in enumerate(run) if k != at)
            value = leaf(tampered(row))
            for at, run in [*path, *top]:
                value = sha256("".join(value if k == at else d for k, d in enumerate(run)).encode()).hexdigest()
            found.append((row[0], leaf(row), subroot, root, sha256(siblings.encode()).hexdigest(), value, value == root))
    return found


def manifest_rows(seed, count):
    pick = random.Random(seed)
    rows = [(None, "No ID", "en", "s", 4), (None, None, None, None, None), (5, "Twice", "en", "s", 5), (5, "Twice", "en", "s", 5), (5, "Other", "en", "s", 5),
            (-3, "", "é", "s", 0), (6, "B" * 300_000, "zz", "s", 1), (7, "Only one", "Z", "ß", 8)]
    return rows + [(100 + i, f"Text {i}", pick.choice(["en", "en", "en", "de"]), "s", i) for i in range(count)]


def third(row):
    import zlib

    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
    return (row[0], None if row[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), row[1]), *row[2:]) if hit else row


@pytest.mark.parametrize(("count", "height"), [(0, 4), (60, 1), (700, 2), (700, 1), (1500, 4)])
def test_manifest_equals_brute_force(spark, monkeypatch, count, height):
    """Low blocks take several rounds up and down."""
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**height)
    rows = manifest_rows(count, count)
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    got = merkle_manifest.manifest(frame(spark, rows), tampered={"text": merkle_manifest.lower_capitals(F.col("text"))}, where=hit)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = manifest_by_brute_force(rows, third)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    docs = frame(spark, [(1, "Alone", "en", "s", 5)])
    (row,) = merkle_manifest.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf((1, "Alone", "en", "s", 5)) and row.verified
    assert row.proof_sha256 == sha256(b"").hexdigest()
    assert merkle_manifest.manifest(docs.limit(0)).count() == 0


def test_many_groups_make_a_tree_of_their_own(spark):
    rows = [(i, f"T{i}", f"g{i % 70:02d}", "s", i) for i in range(200)]
    got = merkle_manifest.manifest(frame(spark, rows)).collect()
    want = manifest_by_brute_force(rows, lambda row: row)
    assert sorted((r.doc_id, r.proof_sha256, r.root) for r in got) == sorted((w[0], w[4], w[3]) for w in want)
    assert all(r.verified for r in got)


# workers that do not have this repository on their path

AWAY = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path only
from assayline.session import build_session
from assayline.llm import decontamination, recurrent_lm, toxicity
from pyspark.sql import functions as F
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
spark.sparkContext.setLogLevel("OFF")

def path(_):
    import importlib.util
    yield importlib.util.find_spec("assayline") is None

assert all(spark.sparkContext.parallelize([1, 2], 2).mapPartitions(path).collect()), "the workers see the repository"
docs = spark.createDataFrame([(i, "some plain words that fill a line of text number %d of this test. bad bad" % i) for i in range(30)], "doc_id long, text string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 30
items = spark.createDataFrame([(1, "plain words that fill a line of text")], "item_id long, text string")
assert decontamination.mark_leaks(docs, items).where("size(leaks) = 1").count() == 30
assert recurrent_lm.score(docs, usable=F.lit(True)).where("score < 0").count() == 30
print("all ran")
"""


def test_operators_run_where_workers_lack_the_repository(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "away.py"
    script.write_text(AWAY.format(repo=repo))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
