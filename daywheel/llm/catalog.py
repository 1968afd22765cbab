"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anntree, bpe, decontaminate, divergence, jaccard, language, mixing, pii, quality, tokenfile, toxicity, trie, urls

from .common import LOWER, UPPER

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anntree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_copies(_table(spark, sf_dir, "documents"))
    taken = (F.col("__mix_size") * F.col("__mix_copies")).alias("taken")
    return rows.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken)


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN trim(coalesce(text, ''), {BLANK_CHARS}) = '' THEN 0
    ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(cap, w * (SELECT min_by(level, cap / w) FROM c WHERE cap >= w * level)) ELSE 0 END AS target FROM c
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + (CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return pairs.drop("__dc_text")


def _shingles_sql(table: str, key: str, text: str = "lower(text)") -> str:
    """Distinct five-word shingles of a table: (key, s)."""
    return f"""
  SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
    FROM (SELECT {key}, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)"""


OP10_SQL = f"""
WITH d AS ({_shingles_sql('documents', 'doc_id')}), b AS ({_shingles_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS matched, count(*) / n AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(n * 0.8::DOUBLE - 1e-9)
"""


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    rows = rows.select("doc_id", "pii", base.alias("base"))
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), pii.scores(F.col("pii")).alias("scores"), F.size("pii").cast("long").alias("n_spans"))


def _sql_hits(kind: str, pattern: str, check: str) -> str:
    """Spans of one kind as a list of {s, e, score}; pieces and hits alternate in the text."""
    hits, pieces = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    near, most = f"{pii.BESIDE}(?:{pii.WORDS[kind]})s?{pii.BESIDE}", pii.CONTEXT
    before, after = f"substr(t, greatest(h.s - {most + 1}, 0) + 1, least(h.s, {most + 1}))", f"substr(t, h.s + length(h.m) + 1, {most + 1})"
    sides = f"CASE WHEN h.s <= {most} THEN ' ' ELSE '' END || {before} || left(h.m, 1)", f"right(h.m, 1) || {after} || CASE WHEN length(t) - h.s - length(h.m) <= {most} THEN ' ' ELSE '' END"
    words = " OR ".join(f"regexp_matches(translate({x}, '{UPPER}', '{LOWER}'), '{near}')" for x in sides)
    score, gain = pii.SCORES[kind]
    if kind in pii.EDGES:
        check += f" AND NOT regexp_matches(right({before}, 1), '{pii.EDGES[kind]}') AND NOT regexp_matches(left({after}, 1), '{pii.EDGES[kind]}')"
    keep = 0.0 if kind in pii.BASE else pii.KEEP
    return f"""list_filter(list_transform(list_filter(list_transform(generate_series(1, len({hits})), lambda i: {{'m': {hits}[i],
      's': (list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda x: length(x))), 0))::BIGINT}}),
      lambda h: {check}), lambda h: {{'k': '{kind}', 's': h.s, 'e': h.s + length(h.m), 'score': CASE WHEN {words} THEN {score + gain} ELSE {score} END::DOUBLE}}), lambda x: x.score >= {keep}::DOUBLE)"""


def _op8_sql() -> str:
    number = "regexp_replace(h.m, '[^0-9]', '', 'g')"
    twice = f"(substr(reverse({number}), k, 1)::INT * 2)"
    luhn = f"list_sum(list_transform(generate_series(1, len({number})), lambda k: CASE WHEN k % 2 = 0 THEN CASE WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END ELSE substr(reverse({number}), k, 1)::INT END)) % 10 = 0"
    account = "replace(h.m, ' ', '')"
    turned = f"(substr({account}, 5) || substr({account}, 1, 4))"
    numbers = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    mod = f"list_reduce(list_prepend(0, {numbers}), lambda r, c: CASE WHEN c >= 10 THEN (r * 100 + c) % 97 ELSE (r * 10 + c) % 97 END) = 1"
    kinds = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "len(list_filter(string_split(h.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0"),
        "card": ("[0-9](?:[ -]?[0-9])+", f"len({number}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": ("\\+[0-9][ ().0-9-]+[0-9]", f"len({number}) BETWEEN 9 AND 15"),
        "iban": (pii.PATTERNS["iban"][0], f"len({account}) BETWEEN 15 AND 34 AND {mod}"),
        "ssn": (pii.PATTERNS["ssn"][0], "true"),
        "secret": (pii.PATTERNS["secret"][0], "regexp_matches(h.m, '[0-9]') AND regexp_matches(h.m, '[a-f]')"),
    }
    lists = ",\n".join(f"{_sql_hits(k, p, c)} AS {k}" for k, (p, c) in kinds.items())
    every = "list_concat(list_concat(email, ip), list_concat(card, phone))"
    text = "lambda x: x.k || ':' || x.s || ':' || x.e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {lists} FROM d),
g AS (SELECT *, {every} AS base, list_concat(list_concat({every}, iban), list_concat(ssn, secret)) AS found FROM f)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
  sha256(array_to_string(list_transform(base, {text}), ',')) AS base_sha256, array_to_string(list_transform(found, {text}), ',') AS spans,
  array_to_string(list_transform(found, lambda x: printf('%.2f', x.score)), ',') AS scores, len(found)::BIGINT AS n_spans FROM g"""


OP8_SQL = _op8_sql()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _op9_sql() -> str:
    fold = "list_reduce(list_prepend('', string_split(path, '/')[2:]), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*\\z', '') ELSE a || '/' || x END)"
    plain = lambda pattern: _q(pattern.replace("*+", "*").replace("++", "+"))
    blank = "[ \\t\\r\\n\\f]"

    def absolute(target: str, base: str) -> str:
        """A link's target seen from a base."""
        t = f"regexp_replace(regexp_replace({target}, '{urls.AMPERSAND}', '&', 'g'), '(?s)#.*', '')"
        origin, rest = f"regexp_extract({base}, '^([^:]*://[^/?#]*)', 1)", f"substr({base}, instr({base}, '://') + 3)"
        path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
        folder = f"regexp_extract({path}, '^(.*/)', 1)"
        return f"""CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^([^:]*:)', 1) || {t} WHEN starts_with({t}, '/') THEN {origin} || {t} WHEN starts_with({t}, '?') THEN {origin} || {path} || {t}
  ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {t} END"""

    def attribute(name: str) -> str:
        """A tag's first attribute of this name."""
        first = f"list_filter(regexp_extract_all(tag, '{plain(urls.ATTRIBUTE)}'), lambda x: regexp_matches(x, '(?i)^{name}{blank}*='))[1]"
        return f"regexp_replace({first}, '{plain(urls.BARE)}', '', 'g')"

    tags = f"regexp_extract_all(html, '{plain(urls.MARKUP)}')"
    unquoted = "CASE WHEN left(content, 1) IN (chr(34), chr(39)) THEN string_split(substr(content, 2), left(content, 1))[1] ELSE content END"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

    def parts(url: str, source: str) -> str:
        """(url, host, path, node) of the URLs of a table."""
        rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) END"
        low = f"translate(substr(url, 1, instr(url, '://') - 1), '{UPPER}', '{LOWER}')"
        return f"""SELECT *, CASE WHEN rest IS NOT NULL THEN {low} || '://' || host || CASE WHEN regexp_matches(path, '{urls.DOTS}') THEN
    {fold} || CASE WHEN string_split(path, '/')[-1] IN ('.', '..') OR {fold} = '' THEN '/' ELSE '' END
    WHEN path = '' THEN '/' ELSE path END || regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) END AS node
  FROM (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM (SELECT *, {rest} AS rest FROM {source}))"""

    won = f"arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM {{}} JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)"
    return f"""
WITH RECURSIVE p AS ({parts('url', 'pages')}),
r(verdict, rh, rp) AS (VALUES {rules}),
tags AS (SELECT page_id, url, node, unnest({tags}) AS tag, unnest(generate_series(1, len({tags}))) AS k FROM p WHERE rest IS NOT NULL),
cells AS (SELECT *, {attribute('href')} AS href, regexp_extract({attribute('content')}, '{_q(urls.AFTER_SECONDS)}', 1) AS content, translate({attribute('http-equiv')}, '{UPPER}', '{LOWER}') AS equiv,
  regexp_split_to_array(translate({attribute('rel')}, '{UPPER}', '{LOWER}'), '{blank}+') AS rel FROM tags WHERE regexp_matches(tag, '{plain(urls.WANTED)}')),
aimed AS (SELECT node AS src, url AS page, CASE WHEN regexp_matches(tag, '(?i)^<link') THEN CASE WHEN list_contains(rel, 'canonical') THEN href END
    WHEN regexp_matches(tag, '(?i)^<meta') THEN CASE WHEN equiv = 'refresh' THEN {unquoted} END END AS x,
  first_value(CASE WHEN regexp_matches(tag, '(?i)^<base') THEN href END IGNORE NULLS) OVER (PARTITION BY page_id, url, node ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM cells),
wanted AS (SELECT src, page, base, trim(regexp_replace(x, '[\\t\\r\\n]', '', 'g'), ' ') AS x FROM aimed WHERE x IS NOT NULL),
based AS (SELECT src, x, coalesce({absolute('base', 'page')}, page) AS url FROM wanted),
goal AS (SELECT src, {absolute('x', 'url')} AS url FROM based),
links AS (SELECT src, node AS dst FROM ({parts('url', 'goal')}) WHERE src <> node),
ends AS (SELECT src AS x, dst AS y FROM links UNION SELECT dst, src FROM links),
reach(x, y) AS (SELECT x, x FROM ends UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
nodes AS ({parts('url', '(SELECT DISTINCT x AS url FROM ends)')}),
said AS (SELECT node, {won.format('nodes')} GROUP BY node),
bad AS (SELECT reach.x AS node FROM reach JOIN said ON said.node = reach.y GROUP BY reach.x HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')),
b AS (SELECT page_id, url, {won.format('(SELECT DISTINCT page_id, url, host, path FROM p)')} GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON b.page_id IS NOT DISTINCT FROM p.page_id AND b.url IS NOT DISTINCT FROM p.url LEFT JOIN bad ON bad.node = p.node
"""


OP9_SQL = _op9_sql()


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, _table(spark, sf_dir, "labels")).withColumn("held_out", quality.held_out(F.col("doc_id")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    predicted = (F.col("tox_score") >= 0.5).cast("int").alias("predicted")
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), predicted, F.col("tox_flag").alias("flagged"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH RECURSIVE s AS ({_shingles_sql('documents', 'doc_id', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n c ON c.doc_id = a.doc_id JOIN n d ON d.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, c.n, d.n HAVING 100 * count(*) >= 80 * (c.n + d.n - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(trie.rebuild(trie.turns(_table(spark, sf_dir, "conversations")))).drop("node")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    bit = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, ascii(x)::BIGINT), [0::BIGINT for k in range(8)]), lambda a, b: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT for x in string_split({text}, '')]), lambda c, x: {byte.replace('ascii(x)::BIGINT', 'x')}), 4294967295)"


OP11_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {_crc32_sql('conv_id::VARCHAR')} % {trie.PREFIXES} AS h FROM (SELECT DISTINCT conv_id FROM t)),
m AS (SELECT c.conv_id, 0 AS k, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {trie.FAMILY} AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS MATERIALIZED (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list([role, text] ORDER BY k, pos) AS turns FROM m GROUP BY conv_id) USING (conv_id)),
p AS MATERIALIZED (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM l)),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends)), sha256('')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS MATERIALIZED (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(path[depth][2])) ELSE 0 END AS saved FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:a] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(generate_series(0, depth)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN u USING (path) LEFT JOIN n up ON w.depth > 0 AND up.path = w.path[1:w.depth - 1]
"""


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bpe_ids")
    listed = F.array_join(F.col("bpe_ids").cast("array<string>"), " ")
    digests = F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bpe_text", 256).alias("decoded_sha256")
    return bpe.decode(ids).select("doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"), *digests)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT k, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM w GROUP BY lang, term HAVING sum(docs) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(w.n, 0) AS n, kept.n AS n_lang FROM g JOIN kept USING (lang)
  LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = kept.term),
t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT c.lang, c.source, term, n, (1 + ({divergence.SCALE}::HUGEINT * (n + {divergence.PRIOR})) // (t.total + {divergence.PRIOR} * v))::BIGINT AS p,
    (1 + ({divergence.SCALE}::HUGEINT * (n_lang + {divergence.PRIOR})) // (v.total + {divergence.PRIOR} * v))::BIGINT AS q
  FROM c JOIN t ON t.lang = c.lang AND t.source = c.source JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f) WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_vectors": op1_nearest_vectors,
        "op2_mix_sources": op2_mix_sources,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_token_files": op6_token_files,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_personal_data": op8_personal_data,
        "op9_url_filter": op9_url_filter,
        "op10_decontaminate": op10_decontaminate,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_bpe_round_trip": op12_bpe_round_trip,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op7_jaccard_join": OP7_SQL, "op8_personal_data": OP8_SQL, "op9_url_filter": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op13_source_divergence": OP13_SQL}
