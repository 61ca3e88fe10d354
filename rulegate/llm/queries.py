"""One query per operator over the test tables, and the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegate.llm import bpe, language_id, lexical, merkle, neighbours, packing, quality_rules, repeats, secret_scan, simhash, toxicity, url_filter, warc
from rulegate.llm.common import held_out, table
from rulegate.session import materialize, scratch_path

VOCABULARY = "byte_bpe_50k.json"

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
# The list applied where no rule fits
URL_LIST = [("cheap-pills.example.com/", "block"), ("spam-farm.example.org/", "block")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op1_quality_rules(spark, sf_dir):
    rows = materialize(quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents"))), "quality-ledger")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE)).cast("long")) != 0
    return quality_rules.judge(rows).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        "kept",
        "fail_bits",
    )


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~out))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op3_bpe_codec(spark, sf_dir):
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels.where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op5_url_filter(spark, sf_dir):
    listed = url_filter.entries(spark, URL_RULES, "rule").union(url_filter.entries(spark, URL_LIST, "list"))
    judged = url_filter.judge(table(spark, sf_dir, "pages"), listed)
    return judged.select("page_id", "host", "path", F.when(F.col("listed_by") == "rule", F.col("entry")).alias("rule"), "verdict")


@query
def op6_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_warc(spark, sf_dir):
    planned = warc.plan(table(spark, sf_dir, "pages"))
    read = warc.read_records(warc.write_archive(planned, scratch_path(spark, "warc")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["order"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"),
    )


@query
def op11_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_merkle(spark, sf_dir):
    altered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(altered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": text})
    folded = merkle.fold(F.col("tampered_leaf"), F.col("witness")).alias("folded_root")
    proof = F.sha2(merkle.proof(F.col("witness")), 256).alias("proof_sha256")
    found = rows.select("doc_id", "leaf", "subroot", "root", proof, folded)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_substring_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


SQL["op1_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i : i + 7] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) > 7)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(x, '[^\p{L}\p{M}]+', '', 'g')) AS n_letters
  FROM t LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 60 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits & (127 - 8) = 0 AS kept,
  CAST(bits AS BIGINT) AS fail_bits
FROM b"""

SQL["op5_url_filter"] = r"""
WITH listed(host, path, verdict, by_rule) AS (VALUES
  ('org', '/', 'allow', 1), ('example.org', '/es/', 'block', 1), ('example.org', '/en/1', 'block', 1),
  ('com', '/fr/', 'allow', 1), ('com', '/de/', 'block', 1),
  ('cheap-pills.example.com', '/', 'block', 0), ('spam-farm.example.org', '/', 'block', 0)),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
best AS (
  SELECT page_id, arg_max({'entry': l.host || l.path, 'verdict': l.verdict, 'by_rule': by_rule}, by_rule * 1000000 + length(l.host || l.path)) AS b
  FROM p JOIN listed l ON starts_with(p.path, l.path) AND (p.host = l.host OR ends_with(p.host, '.' || l.host)) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, CASE WHEN b.by_rule = 1 THEN b.entry END AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best USING (page_id)"""

SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
    max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM q"""


def _secret_sql() -> str:
    """Spans from the stretches between matches, as lists of lengths; one block per kind."""
    folded = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(folded, ("password", "passwd", "secret", "token", "api")[:4]), folded("api") + "_?" + folded("key")])
    kinds = {
        "assign": (f"(?:{words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 20),
        "hex": ("[0-9a-f]{24,}", 0, 24),
        "github": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
        "private_key": ("-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    }
    blocks = []
    for order, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        blocks.append(f"""
  SELECT doc_id, {order} AS ord, '{kind}' AS kind,
    list_sum(list_transform(pieces[1 : k], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1 : k - 1], lambda s: length(s))), 0) AS a,
    length(found[k]) AS n, length(regexp_extract(found[k], '{pattern}', {group})) AS g, {least} AS least
  FROM (
    SELECT doc_id, pieces, found, unnest(range(1, len(found) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(x, '{pattern}') AS found, regexp_split_to_array(x, '{pattern}') AS pieces FROM t)
    WHERE len(found) > 0)""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS ({" UNION ALL ".join(blocks)}),
f AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM s WHERE g >= least),
d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3) AS base,
    string_agg(span, ',' ORDER BY a, ord) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)"""


SQL["op10_secret_scan"] = _secret_sql()


SQL["op11_lexical_search"] = r"""
WITH terms AS (
  SELECT row, doc_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (
    SELECT row_number() OVER () AS row, doc_id, text, false AS item FROM documents
    UNION ALL SELECT row_number() OVER () AS row, item_id, text, true FROM benchmark)),
sizes AS (SELECT row, any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM terms WHERE NOT item GROUP BY row),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM sizes),
held AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM terms WHERE NOT item GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, corpus GROUP BY term),
asked AS (SELECT row AS item_row, any_value(doc_id) AS item_id, term, count(*) AS repeats FROM terms WHERE item GROUP BY row, term),
parts AS (
  SELECT row, term, (CAST(1000000000 AS BIGINT) * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens)) AS part
  FROM held JOIN sizes USING (row), corpus WHERE term IN (SELECT term FROM asked)),
scores AS (
  SELECT item_row, any_value(item_id) AS item_id, row, CAST(sum(repeats * w * part) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY item_row, row HAVING sum(repeats * w * part) > 0),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN sizes USING (row))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def _merkle_sql() -> str:
    """Levels by recursion; a row's siblings are the nodes that share the parent of its node on a level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    levels = lambda name, start: f"""
{name}(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, h, count(*) OVER (PARTITION BY tree) FROM {start}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3)"""  # noqa: E731
    steps = lambda rows, nodes: f"""
  SELECT r.row, s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < r.pos // CAST(3 ** s.lvl AS BIGINT)), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > r.pos // CAST(3 ** s.lvl AS BIGINT)), '') AS r
  FROM {rows} r JOIN {nodes} s ON r.tree = s.tree AND s.n > 1 AND s.pos // 3 = r.pos // CAST(3 ** (s.lvl + 1) AS BIGINT)
  GROUP BY r.row, s.lvl"""  # noqa: E731
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS t),
d AS (
  SELECT documents.*, row_number() OVER () AS row, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, s: xor(c // 256, crc.t[xor(c, s) % 256 + 1])), CAST(4294967295 AS BIGINT)) % 2 = 0 AS altered FROM documents, crc),
x AS (
  SELECT row, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf("text")} AS h,
    CASE WHEN altered THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, row) - 1 AS pos FROM x),
{levels("a", "leaves")},
roots AS (SELECT 0 AS tree, tree AS pos, tree AS row, h FROM a WHERE n = 1),
{levels("b", "roots")},
s AS ({steps("leaves", "a")}),
t AS ({steps("roots", "b")}),
path AS (
  SELECT row, lvl, l, r FROM s
  UNION ALL SELECT leaves.row, 1000 + t.lvl, t.l, t.r FROM leaves JOIN t ON leaves.tree = t.row),
fold(row, k, h) AS (
  SELECT row, 0, other FROM leaves
  UNION ALL
  SELECT fold.row, k + 1, sha256(p.l || fold.h || p.r) FROM fold JOIN (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY lvl) - 1 AS step FROM path) p ON p.row = fold.row AND p.step = fold.k),
last AS (SELECT row, arg_max(h, k) AS h FROM fold GROUP BY row),
proofs AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY lvl)) AS h FROM path GROUP BY row),
top AS (SELECT h FROM b WHERE n = 1)
SELECT doc_id, leaves.h AS leaf, roots.h AS subroot, top.h AS root, coalesce(proofs.h, sha256('')) AS proof_sha256,
  last.h AS folded_root, last.h = top.h AS verified
FROM leaves JOIN roots ON leaves.tree = roots.pos JOIN last ON last.row = leaves.row LEFT JOIN proofs ON proofs.row = leaves.row, top"""


SQL["op12_merkle"] = _merkle_sql()

SQL["op13_substring_dedup"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT row, i, md5(array_to_string(words[i : i + 34], ' ')) AS w FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM t WHERE len(words) > 34)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT row, list_distinct(flatten(list(range(i, i + 35)))) AS p FROM twice GROUP BY row),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY k) AS x, count(*) AS n
  FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM t)
  ANTI JOIN (SELECT row, unnest(p) AS k FROM gone) USING (row, k) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(x, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row)"""
