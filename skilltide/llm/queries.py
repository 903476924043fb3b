"""The operators of this subpackage on the given tables, with their SQL where there is one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .exact import exact_duplicates
    return exact_duplicates(read(spark, folder, "documents"))


SQL["op9_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contamination
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


SQL["op5_decontamination"] = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w : w <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w : w <> '') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
    array_to_string(words[i + 1:i + least(len(words), 10)], ' ') AS w
  FROM (SELECT *, unnest(range(greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, i, s.n AS n, array_to_string(words[i + 1:i + s.n], ' ') AS w
  FROM (SELECT d.doc_id, d.words, s.n, unnest(range(len(d.words) - s.n + 1)) AS i
        FROM d JOIN (SELECT DISTINCT n FROM bw) s ON len(d.words) >= s.n) s),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (n, w)),
pos AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import jaccard_links
    return jaccard_links(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


SQL["op10_jaccard_join"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
    '[^\\p{L}\\p{N}]+'), lambda w : w <> '') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + least(len(words), 5)], ' ') AS s
  FROM (SELECT *, unnest(range(greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 10 * c >= 8 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
k AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY 1),
deg AS (SELECT x, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN k ON k.x = doc_id LEFT JOIN deg ON deg.x = doc_id
"""


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identify
    return identify(read(spark, folder, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from .bpe import digests
    return digests(read(spark, folder, "documents"), vocabulary_path())


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import license_scan
    return license_scan(read(spark, folder, "documents"))


def _license_sql() -> str:
    from .license_texts import TEMPLATES
    from .licenses import THRESHOLD
    quoted = [(i, *(x.replace("'", "''") for x in t)) for i, t in enumerate(TEMPLATES)]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in quoted)
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(template, license, x)),
tg AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (
    SELECT template, license, list_filter(string_split_regex(lower(x), '[^\\p{{L}}\\p{{N}}]+'),
      lambda y : y <> '') AS w FROM t))),
ts AS (SELECT template, count(*) AS tn FROM tg GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS x,
  regexp_replace(coalesce(text, ''), '(?im)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '', 'g') AS y
  FROM documents),
u AS (SELECT DISTINCT doc_id, u FROM (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS u FROM d
  UNION ALL SELECT doc_id, unnest(string_split_regex(y, '\\n[ \\t\\r]*\\n')) FROM d
  UNION ALL SELECT doc_id, y FROM d)),
un AS (SELECT doc_id, row_number() OVER () AS unit, list_filter(string_split_regex(lower(u),
  '[^\\p{{L}}\\p{{N}}]+'), lambda y : y <> '') AS w FROM u),
ug AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM un)),
us AS (SELECT unit, count(*) AS n FROM ug GROUP BY 1),
m AS (SELECT ug.doc_id, ug.unit, tg.template, tg.license,
    CAST(2 * count(*) AS DOUBLE) / (any_value(n) + any_value(tn)) AS dice
  FROM ug JOIN tg USING (g) JOIN us USING (unit) JOIN ts USING (template) GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, unit, license, dice, row_number() OVER (
    PARTITION BY unit ORDER BY dice DESC, template) AS k FROM m WHERE dice >= {THRESHOLD}),
r AS (SELECT doc_id, count(*) AS n, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license)
  AS names FROM best WHERE k = 1 GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, dice AS best_dice
FROM d LEFT JOIN r USING (doc_id)
"""


SQL["op1_license_scan"] = _license_sql()


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import grades_of_labels, toxicity
    return toxicity(read(spark, folder, "documents"), grades_of_labels(read(spark, folder, "labels")))


@query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from .urls import judge_urls
    return judge_urls(read(spark, folder, "pages"))


@query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from .pii import personal_data
    return personal_data(read(spark, folder, "documents"))


@query
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    from .warc import archived
    return archived(read(spark, folder, "pages"))


SQL["op2_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM g
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .align import alignments
    found = alignments(read(spark, folder, "documents"), vocabulary_path(),
                       public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return found.drop("groups")


@query
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import quality_scores
    return quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from .repair import repair_damaged
    return repair_damaged(read(spark, folder, "conversations"))


def _repair_sql() -> str:
    """Costs and audits of a suffix are one string each, of twelve digits and then the edits."""
    def add(cost: str | int, edit: str, s: str) -> str:
        return f"lpad(CAST(CAST(left({s}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{edit}' || substr({s}, 13)"

    short = "CASE WHEN f = 't' THEN 5 ELSE 0 END"

    def stay(edit: str, cost: int, s: str, condition: str = "true") -> str:
        return f"CASE WHEN f NOT IN ('b', 'd') AND {condition} THEN {add(f'{cost} + {short}', edit, s)} END"

    def best(q: int, kept: dict[str, str], wanted: str) -> str:
        keeps = "".join(f", {stay('K', 0, s, f"init = '{c}'")}" for c, s in kept.items())
        return f"least({add(2, 'D', f's{q}')}{keeps}, {stay('R', 1, wanted)}) AS b{q}"

    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda c : CAST(unicode(c) AS BIGINT))),
      lambda c, b : list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda z, k : CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)), 4294967295) % 20 AS k
  FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last, left(role, 1) AS init
  FROM dam),
flt AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't'
    ELSE '' END AS f, lag(init) OVER (PARTITION BY conv_id ORDER BY p) AS prev
  FROM num),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (p > 1 AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flt GROUP BY 1),
rec AS (
  SELECT conv_id, n + 1 AS i, lpad('', 12, '0') AS s0, lpad('10', 12, '0') || 'II' AS s1,
    lpad('5', 12, '0') || 'I' AS s2, lpad('', 12, '0') AS s3 FROM cnt
  UNION ALL
  SELECT conv_id, i, least(b0, {add(5, 'I', 'i2')}), least(b1, {add(5, 'I', 'i2')}), i2,
    least(b3, {add(5, 'I', 'b2')})
  FROM (SELECT *, least(b2, {add(5, 'I', 'b3')}) AS i2 FROM (
    SELECT rec.conv_id, i - 1 AS i, {best(0, {'s': 's1', 'u': 's2'}, 's2')}, {best(1, {'u': 's2'}, 's2')},
      {best(2, {'a': 's3'}, 's3')}, {best(3, {'u': 's2'}, 's2')}
    FROM rec JOIN flt ON flt.conv_id IS NOT DISTINCT FROM rec.conv_id AND flt.p = rec.i - 1))),
aud AS (SELECT conv_id, CAST(left(s0, 12) AS BIGINT) AS cost, substr(s0, 13) AS audit FROM rec WHERE i = 1),
let AS (
  SELECT conv_id, j, substr(audit, j, 1) AS e FROM (
    SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM aud)),
pos AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS p, count(*) FILTER (e <> 'D') OVER w AS o
  FROM let WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lin AS (
  SELECT pos.conv_id, e, o, role, text, max(CASE WHEN o = 1 AND e = 'K' AND init = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY pos.conv_id) AS sys
  FROM pos LEFT JOIN flt ON flt.conv_id IS NOT DISTINCT FROM pos.conv_id AND flt.p = pos.p AND e <> 'I'),
rep AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS x
  FROM lin WHERE e <> 'D' GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN aud ON aud.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL["op12_conversation_repair"] = _repair_sql()
