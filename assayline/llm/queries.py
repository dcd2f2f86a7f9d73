"""The named queries of the text operators over the standard tables, and SQL equivalents where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; its SQL, if any, must give the same rows."""
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


from assayline.llm import decontamination, filter_audit, fingerprints, line_dedup, merkle_manifest, near_dedup, packing, recurrent_lm, sharding, substring_dedup, token_fertility, toxicity, url_filter  # noqa: E402
from assayline.llm.common import remainder  # noqa: E402

NEAR_SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT rep AS node, rep AS seen FROM classes UNION SELECT r.node, p.y FROM reach r JOIN pairs p ON r.seen = p.x),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(len(d.s), 0) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
  d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND list_sort(d.s) = c.s LEFT JOIN roots r ON r.node = c.rep"""


@query("op5_near_dedup", NEAR_SQL)
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=2, percent=80).drop("text_key")


REPEATS_SQL = """WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS s, w FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, list(s) AS begins FROM windows SEMI JOIN again USING (h) GROUP BY doc_id),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list_transform(begins, lambda q: generate_series(q, q + 34))))) AS g FROM hit),
numbered AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words),
lost AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM numbered ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.k, '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


@query("op8_substring_dedup", REPEATS_SQL)
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, folder, "documents"), window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file(), capacity=4096, end_id=1)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), usable=remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        F.col("toxic").alias("predicted"), "offending")


RULES = (
    url_filter.Rule("org", "/", True), url_filter.Rule("example.org", "/es/", False), url_filter.Rule("example.org", "/en/1", False),
    url_filter.Rule("com", "/fr/", True), url_filter.Rule("com", "/de/", False),
)


def _terms(terms) -> str:
    return "|".join(terms)


# The automaton's boundary rule as two patterns: terms here consist of letters only.
URL_SQL = f"""WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS p FROM pages),
split AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(u, p + 3), '^[^?#]*') END AS rest FROM parts),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN position('/' IN rest) = 0 THEN '' ELSE substr(rest, position('/' IN rest)) END AS path FROM split),
rules(h, p, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{'allow' if r.allow else 'block'}')" for r in RULES)}),
fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM named JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
spread AS (SELECT page_id, host, path, ' ' || regexp_replace(lower(host || path), '[^\\p{{L}}]', '  ', 'g') || ' ' AS u FROM named),
found AS (
  SELECT page_id, host, path, len(regexp_extract_all(u, ' (?:{_terms(url_filter.STRICT)}) ')) AS s,
    list_sort(list_distinct(list_transform(regexp_extract_all(u, ' (?:{_terms(url_filter.SOFT)}) '), lambda x: trim(x)))) AS t FROM spread)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN s > 0 OR len(t) > 1 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(s AS INTEGER) AS strict_hits, array_to_string(t, ' ') AS soft_terms FROM found LEFT JOIN fit USING (page_id)"""


@query("op9_url_filter", URL_SQL)
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages"), RULES)
    return judged.withColumn("soft_terms", F.array_join("soft_terms", " "))


def crc32_entries() -> list[int]:
    """The byte table of CRC-32, from its polynomial."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    return entries


SHARD_SQL = f"""WITH tab AS MATERIALIZED (SELECT CAST({crc32_entries()} AS BIGINT[]) AS e),
bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT doc_id, source, size, xor(4294967295, list_reduce(
    list_transform(generate_series(1, size - 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, e[1 + (xor(a, b) & 255)]), 4294967295)) AS text_crc32 FROM bytes, tab),
drawn AS (
  SELECT doc_id, source, size, text_crc32, CAST('0x' || substr(md5('0|' || doc_id), 1, 15) AS BIGINT) AS draw FROM crc),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS f FROM drawn),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY f, source IS NULL, coalesce(source, ''), draw, doc_id) - 1 AS g, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 16 // n AS INTEGER) AS shard,
  g - ((g * 16 // n) * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered"""


@query("op3_sharding", SHARD_SQL)
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return sharding.interleave(rows, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _print_sql(text: str) -> str:
    """A fingerprint in SQL; columns x_p, x_s, x_l are its levels."""
    return f"""(SELECT sha256(array_to_string(s, ' ')) || ':' || array_to_string(s, ' ') || ':' || array_to_string(p, ' ') || ':' || array_to_string(l, ' ')
    FROM (SELECT p, l, list_transform(list_filter(regexp_split_to_array(array_to_string(list_transform(p,
      lambda d: CASE WHEN d[1] IN ('0', '1') THEN d || '/' ELSE d END), ' '), '/ ?'), lambda z: z <> ''), lambda z: substr(sha256(z), 1, 32)) AS s
    FROM (SELECT list_transform(string_split({text}, chr(10)), lambda q: substr(sha256(q), 1, 32)) AS p,
      list_transform(regexp_extract_all({text}, '[^.!?\\n]{{1,120}}[.!?]*'), lambda q: substr(sha256(q), 1, 8)) AS l)))"""


def _like_sql(one: str, other: str) -> str:
    def pieces(fp: str) -> str:
        return f"list_distinct(list_filter(string_split(split_part({fp}, ':', 4), ' '), lambda d: d <> ''))"

    return f"""CASE WHEN split_part({one}, ':', 1) = split_part({other}, ':', 1) THEN 1.0 WHEN len({pieces(one)}) + len({pieces(other)}) = 0 THEN 0.0
    ELSE CAST(2.0 AS DOUBLE) * len(list_intersect({pieces(one)}, {pieces(other)})) / (len({pieces(one)}) + len({pieces(other)})) END"""


PRINT_SQL = f"""WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM rows),
edited AS (
  SELECT doc_id, text, next_text, length(text) AS n, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edit FROM paired),
printed AS (
  SELECT doc_id, n, sha256(edit) AS edited_sha256, {_print_sql('text')} AS fingerprint, {_print_sql('edit')} AS edited_fingerprint,
    {_print_sql('next_text')} AS next_fingerprint FROM edited)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_like_sql('fingerprint', 'edited_fingerprint')} AS near_edited, {_like_sql('fingerprint', 'next_fingerprint')} AS near_next FROM printed"""


@query("op4_fingerprints", PRINT_SQL)
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fingerprints.with_next(table(spark, folder, "documents"))
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - half), F.substring("next_text", F.lit(1), half))
    printed = pairs.withColumn("n_chars", length).withColumn("edited", edited).select(
        "doc_id", F.col("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text")).alias("fingerprint"), fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprints.fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


LINE_SQL = """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents),
words AS (
  SELECT doc_id, i, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM lines),
classes AS (
  SELECT w, min((doc_id, i)) AS first FROM words WHERE len(w) >= 3 GROUP BY w),
gaps AS (SELECT w, first, len(w) AS n, unnest(generate_series(1, len(w) + 1)) AS g FROM classes WHERE len(w) >= 8),
variants AS (
  SELECT w, first, md5(array_to_string(w[1:g - 1], ' ') || ' # ' || array_to_string(w[g:], ' ') || ' #' || g) AS k FROM gaps
  UNION ALL SELECT w, first, md5(array_to_string(w[1:g - 1], ' ') || ' # ' || array_to_string(w[g + 1:], ' ') || ' #' || g) FROM gaps WHERE g <= n),
earliest AS (SELECT k, min(first) AS lead FROM variants GROUP BY k HAVING count(*) > 1),
near AS (SELECT DISTINCT w FROM variants JOIN earliest USING (k) WHERE lead < first),
gone AS (
  SELECT a.doc_id, a.i FROM words a JOIN classes c ON a.w = c.w LEFT JOIN near n ON n.w = a.w WHERE n.w IS NOT NULL OR (a.doc_id, a.i) <> c.first)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id"""


@query("op2_line_dedup", LINE_SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontamination.mark_leaks(docs, table(spark, folder, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = recurrent_lm.score(table(spark, folder, "documents"), usable=remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), *scored.columns[1:])


AUDIT_SQL = f"""WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM rows GROUP BY text),
known AS (SELECT doc_id, CAST(max(CAST(quality = 1 AS INTEGER)) AS INTEGER) AS good, CAST(max(CAST(toxic = 1 AS INTEGER)) AS INTEGER) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM rows JOIN firsts USING (text) LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, mask),
orders(o) AS (VALUES {", ".join(f"('{''.join(p)}')" for p in permutations('ABCDE'))}),
steps AS (
  SELECT o, i AS step, 1 << (position(substr(o, i, 1) IN 'ABCDE') - 1) AS own,
    coalesce(list_sum(list_transform(generate_series(1, i - 1), lambda j: 1 << (position(substr(o, j, 1) IN 'ABCDE') - 1))), 0) AS ahead
  FROM orders, generate_series(1, 5) AS g(i)),
done AS (
  SELECT part, o, step, own, sum(CASE WHEN mask & (ahead + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & ahead = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & ahead > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & ahead = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & ahead = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, own)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM done"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: Levels in the SQL: enough for 8 ** 7 documents of a language and as many languages.
MANIFEST_LEVELS = 7


def _climb_sql(name: str, start: str) -> str:
    """CTEs ``name``_0 .. from nodes (tree, place, digest): a level's nodes, each run's members as a list, and its tree's width."""
    parts = [f"{name}_0 AS ({start})"]
    for i in range(MANIFEST_LEVELS):
        parts.append(f"""{name}_w{i} AS (SELECT tree, count(*) AS width FROM {name}_{i} GROUP BY tree),
{name}_r{i} AS MATERIALIZED (SELECT n.tree, n.place // 8 AS run, any_value(w.width) AS width, list(n.digest ORDER BY n.place) AS members
  FROM {name}_{i} n JOIN {name}_w{i} w USING (tree) GROUP BY n.tree, n.place // 8),
{name}_{i + 1} AS (SELECT tree, run AS place, CASE WHEN width = 1 THEN members[1] ELSE sha256(array_to_string(members, '')) END AS digest FROM {name}_r{i})""")
    return ",\n".join(parts)


def _fold_sql(name: str, start: str, prefix: str) -> str:
    """CTEs that carry each row (tree, place) of ``start`` up: folded digest and siblings so far."""
    parts = []
    for i in range(MANIFEST_LEVELS):
        at, before = f"s.place // CAST({8 ** i} AS BIGINT)", start if i == 0 else f"{prefix}_{i}"
        parts.append(f"""{prefix}_{i + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (fold, proof),
  CASE WHEN r.width = 1 THEN s.fold ELSE sha256(array_to_string(r.members[:({at}) % 8], '') || s.fold || array_to_string(r.members[({at}) % 8 + 2:], '')) END AS fold,
  CASE WHEN r.width = 1 THEN s.proof ELSE s.proof || array_to_string(r.members[:({at}) % 8], '') || array_to_string(r.members[({at}) % 8 + 2:], '') END AS proof
  FROM {before} s JOIN {name}_r{i} r ON r.tree = s.tree AND r.run = s.place // CAST({8 ** (i + 1)} AS BIGINT))""")
    return ",\n".join(parts)


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST_SQL = f"""WITH tab AS MATERIALIZED (SELECT CAST({crc32_entries()} AS BIGINT[]) AS e),
crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: xor(a >> 8, e[1 + (xor(a, b) & 255)]), 4294967295)) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab),
hashed AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree, sha256({' || '.join(map(_field_sql, ('d.doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256({' || '.join(map(_field_sql, ('d.doc_id', 'source', 'lang', 'n_chars', _LOWER)))}) END AS changed
  FROM documents d LEFT JOIN crc USING (doc_id)),
placed AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS place FROM hashed),
{_climb_sql('low', 'SELECT tree, place, leaf AS digest FROM placed')},
subs AS MATERIALIZED (SELECT tree AS name, '' AS tree, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS place, digest FROM low_{MANIFEST_LEVELS}),
{_climb_sql('top', 'SELECT tree, place, digest FROM subs')},
begun AS (SELECT *, coalesce(changed, leaf) AS fold, '' AS proof FROM placed),
{_fold_sql('low', 'begun', 'own')},
handed AS (
  SELECT o.doc_id, o.leaf, s.digest AS subroot, s.tree, s.place, o.fold, o.proof FROM own_{MANIFEST_LEVELS} o JOIN subs s ON s.name = o.tree),
{_fold_sql('top', 'handed', 'all')}
SELECT a.doc_id, a.leaf, a.subroot, t.digest AS root, sha256(a.proof) AS proof_sha256, a.fold AS folded_root, a.fold = t.digest AS verified
FROM all_{MANIFEST_LEVELS} a JOIN top_{MANIFEST_LEVELS} t ON true"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    third = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return merkle_manifest.manifest(
        table(spark, folder, "documents"), tampered={"text": merkle_manifest.lower_capitals(text)}, where=third)


@query("op12_token_fertility")
def op12_token_fertility(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    judged = token_fertility.judge(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "chars_per_token_2", "fallback_share", "entropy", F.array_join("rejected_by", " ").alias("rejected_by"))
