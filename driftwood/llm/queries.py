"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.chat_format import chat_digests, chat_segments
from driftwood.llm.conversation_repair import STEP, WANTED, repaired
from driftwood.llm.decontaminate import contamination
from driftwood.llm.html_extract import main_text
from driftwood.llm import license_scan as licenses
from driftwood.llm.license_scan import license_scan
from driftwood.llm.line_dedup import line_dedup
from driftwood.llm.near_dedup import near_duplicates
from driftwood.llm.ngram_join import jaccard_components
from driftwood.llm.quality_rules import quality
from driftwood.llm.sentence_pieces import encoded
from driftwood.llm.token_align import token_alignment
from driftwood.llm.token_counts import section_tokens
from driftwood.llm.url_filters import host_of, path_of, url_filtered
from driftwood.sources.tables import table


#: Words of a text in DuckDB: A-Z lower-cased, then runs of letters, digits and all beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The votes of quality_rules.RULES in SQL, in their order.
_VOTES = [
    "CASE WHEN n_words < 10 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "CASE WHEN n_symbols * 20 > word_chars THEN -1 WHEN n_symbols * 100 <= word_chars THEN 1 ELSE 0 END",
    "CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN -1 WHEN n_dup_lines = 0 AND n_lines > 1 THEN 1 ELSE 0 END",
    "CASE WHEN n_repeat_words * 5 > n_words THEN -1 WHEN n_repeat_words * 20 <= n_words THEN 1 ELSE 0 END",
    "CASE WHEN n_upper * 5 > word_chars * 2 THEN -1 WHEN n_upper * 5 <= word_chars THEN 1 ELSE 0 END",
    "CASE WHEN word_chars < n_words * 2 OR word_chars > n_words * 14 THEN -1 WHEN word_chars >= n_words * 3 AND word_chars <= n_words * 10 THEN 1 ELSE 0 END",
    "CASE WHEN n_exclaims * 4 > n_words THEN -1 WHEN n_exclaims * 20 <= n_words THEN 1 ELSE 0 END",
    "CASE WHEN n_distinct * 5 < n_words AND n_words BETWEEN 50 AND 2000 THEN -1 WHEN n_distinct * 5 >= n_words * 2 THEN 1 ELSE 0 END",
]
_R = len(_VOTES)
_SUM = "list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].n * {}))"
_RATE = "least(0.999, greatest({}, (" + _SUM + " + 1) / (" + _SUM + " + 2)))"
_GOOD = ", ".join(_RATE.format(0.99, f"CASE WHEN p[i].v[{j}] = 1 THEN q[i] ELSE 0 END", f"CASE WHEN p[i].v[{j}] <> 0 THEN q[i] ELSE 0 END") for j in range(1, _R + 1))
_BAD = ", ".join(_RATE.format(0.02, f"CASE WHEN p[i].v[{j}] = -1 THEN 1 - q[i] ELSE 0 END", f"CASE WHEN p[i].v[{j}] <> 0 THEN 1 - q[i] ELSE 0 END") for j in range(1, _R + 1))
_PI = "least(0.999, greatest(0.02, (" + _SUM.format("q[i]") + " + 1) / (" + _SUM.format("1") + " + 2)))"
_LOGIT = f"list_sum(list_transform(range(1, {_R + 1}), lambda j: CASE x.v[j] WHEN 1 THEN ln(m.good[j] / (1 - m.bad[j])) WHEN -1 THEN ln((1 - m.good[j]) / m.bad[j]) ELSE 0 END))"
_GUESS = "list_transform(p, lambda x: 1 / (1 + exp(-(ln(m.pi / (1 - m.pi)) + " + _LOGIT + "))))"
OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: translate(x, {_GAPS}, '') <> '') AS l, length(translate(t, {_GAPS}, '')) AS word_chars
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, '{_UP}', '')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclaims, len(list_distinct(w)) AS n_distinct, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (doc_id)
), voted AS (SELECT *, [{", ".join(_VOTES)}] AS v FROM m),
counted AS (SELECT v, count(*)::DOUBLE AS n FROM voted WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) GROUP BY v),
patterns AS (SELECT list(struct_pack(v := v, n := n) ORDER BY v) AS p FROM counted),
em(t, p, q) AS (
  SELECT 0, p, {_GUESS} FROM (SELECT p, struct_pack(pi := 0.9::DOUBLE, good := list_transform(range({_R}), lambda z: 0.99::DOUBLE), bad := list_transform(range({_R}), lambda z: 0.3::DOUBLE)) AS m FROM patterns)
), em_run(t, p, q) AS (
  SELECT t, p, q FROM em
  UNION ALL
  SELECT t + 1, p, {_GUESS} FROM (SELECT t, p, struct_pack(pi := {_PI}, good := [{_GOOD}], bad := [{_BAD}]) AS m FROM em_run WHERE t < 25)
), scored AS (SELECT unnest(p).v AS v, unnest(q) AS posterior FROM em_run WHERE t = 25)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(posterior, 0) >= 0.5 AS kept
FROM voted LEFT JOIN scored USING (v)
"""


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"), rule="first")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 that follows from the id. The list is made of their hosts and top
    folders: a third of these is added, taken off and added again on days that follow from a digest of the key."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    top = F.concat(host_of(F.col("url")), F.lit("/"), F.split(path_of(F.col("url")), "/")[1])
    key = pages.select(F.explode(F.array(host_of(F.col("url")), F.regexp_replace(host_of(F.col("url")), "^[^.]*[.]", ""), top)).alias("key")).where("key <> ''").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("key"), i, 2), 16, 10).cast("int")
    key = key.where(digit(1) % 3 == 0)
    days = [("add", digit(3)), ("remove", digit(3) + digit(5) / 2), ("add", digit(3) + digit(5) / 2 + digit(7) / 4)]
    entry = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int")).alias("day")) for a, d in days))).alias("e")
    out = url_filtered(captures, key.select("key", entry).select("key", "e.day", "e.action"))
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "n_active", "entry", "blocked")


_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
_HEX = "('0x' || substr(md5(key), {}, 2))::INT"
OP4_SQL = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched, {_HOST} AS host, {_PATH} AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM c),
keys AS (
  SELECT DISTINCT key FROM (SELECT unnest([host, regexp_replace(host, '^[^.]*[.]', ''), host || '/' || string_split(path, '/')[2]]) AS key FROM c)
  WHERE key <> '' AND {_HEX.format(1)} % 3 = 0
), entries AS (
  SELECT key, 'add' AS action, DATE '2024-01-01' + {_HEX.format(3)} AS day FROM keys
  UNION ALL SELECT key, 'remove', DATE '2024-01-01' + floor({_HEX.format(3)} + {_HEX.format(5)} / 2)::INT FROM keys
  UNION ALL SELECT key, 'add', DATE '2024-01-01' + floor({_HEX.format(3)} + {_HEX.format(5)} / 2 + {_HEX.format(7)} / 4)::INT FROM keys
), dated AS (SELECT key, day, max(action) AS action FROM entries GROUP BY key, day),
held AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM dated),
cover AS (
  SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')),
    list_transform(range(1, len(p) + 1), lambda i: host || '/' || array_to_string(p[1:i], '/'))))) AS key
  FROM parts WHERE host <> ''
), hits AS (
  SELECT page_id, count(*) AS n_active, first(c.key ORDER BY length(c.key) DESC, c.key) AS entry
  FROM cover c JOIN held h ON c.key = h.key AND h.action = 'add' AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY page_id
)
SELECT page_id, url, fetched::VARCHAR AS fetched, coalesce(n_active, 0) AS n_active, entry, n_active IS NOT NULL AS blocked FROM c LEFT JOIN hits USING (page_id)
"""


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 1, "user", extra), (-1, 2, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(chat_segments(rows))


_ESCAPED = "replace({}, '\\', '\\\\')"
for _x in ("<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_x}', '{_x[0]}\\{_x[1:]}')"
OP5_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 1, 'user', '</s>[INST] ok [/INST]'), (-1, 2, 'assistant', '</s>[INST] ok [/INST]')
), t AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS prev FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 24)::BIGINT AS formatted_chars,
       bool_and(prev || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
FROM t GROUP BY conv_id
"""


def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    out = license_scan(table(spark, folder, "documents"))
    return out.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


_PATTERN_IDS = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{i}'" for p, i in licenses.PATTERNS)
_SPDX_ID = f"list_transform(regexp_extract_all(regexp_extract(s, '^{licenses.SPDX_LINE}$', 1), '{licenses.SPDX_NAME}'), lambda x: 'spdx-' || replace(x, ' ', '-'))"
OP6_SQL = f"""
WITH RECURSIVE sentences(s, id) AS (
  SELECT p.p || n.n || e.e, n.id || '-ref' FROM (VALUES {", ".join(f"('{x}')" for x in licenses.PHRASES)}) p(p), (VALUES {", ".join(f"('{a}', '{b}')" for a, b in licenses.NAMES.items())}) n(n, id), (VALUES {", ".join(f"('{x}')" for x in licenses.ENDINGS)}) e(e)
  WHERE p.p || n.n || e.e NOT IN ({", ".join(f"'{x}'" for x in licenses.SENTENCES)})
  UNION ALL VALUES {", ".join(f"('{a}', '{b}')" for a, b in licenses.SENTENCES.items())}
), rules(pos, license, run) AS (VALUES {", ".join(f"({i}, '{n}', '|{'||'.join(r)}|')" for i, (n, r) in enumerate(licenses.RULES))}),
heads AS (SELECT DISTINCT string_split(s, ' ')[1] AS head FROM sentences),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^[ \t]*(?:C|REM|rem|dnl|@c)([ \t]|$)', '\1', 'g'), '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(translate(x, '{_UP}', '{_LOW}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, i, regexp_matches(array_to_string(w[i:i + 1], ' '), '{licenses.START}') AS free FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut)
  WHERE string_split(w[i], ' ')[1] IN (FROM heads) OR contains(w[i], 'copyright') OR regexp_matches(array_to_string(w[i:i + 1], ' '), '{licenses.START}')
), candidates AS (
  SELECT doc_id, i, e, free, array_to_string(w[i:e], ' ') AS s FROM (SELECT *, unnest(range(i, least(len(w), i + {licenses.WRAPPED} - 1) + 1)) AS e FROM starts)
), named AS (
  SELECT doc_id, i, e, coalesce(id, CASE WHEN e = i AND regexp_full_match(c.s, '{licenses.COPYRIGHT}') THEN 'copyright' END,
    CASE WHEN free THEN (SELECT coalesce(CASE {_PATTERN_IDS} END, CASE WHEN regexp_full_match(s, '{licenses.SPDX_LINE}') THEN array_to_string({_SPDX_ID}, ',') END) FROM (SELECT c.s AS s)) END) AS ids
  FROM candidates c LEFT JOIN sentences USING (s)
), longest AS (SELECT doc_id, i, max(e) AS e, arg_max(ids, e) AS ids FROM named WHERE ids IS NOT NULL GROUP BY doc_id, i),
linked AS (SELECT *, (SELECT min(b.i) FROM longest b WHERE b.doc_id = a.doc_id AND b.i > a.e) AS following FROM longest a),
walk(doc_id, i, ids, following) AS (
  SELECT doc_id, i, ids, following FROM linked WHERE (doc_id, i) IN (SELECT (doc_id, min(i)) FROM longest GROUP BY doc_id)
  UNION ALL SELECT l.doc_id, l.i, l.ids, l.following FROM walk w JOIN linked l ON l.doc_id = w.doc_id AND l.i = w.following
), seqs AS (SELECT doc_id, string_split(string_agg(ids, ',' ORDER BY i), ',') AS ids FROM walk GROUP BY doc_id),
applied(doc_id, pos, rest, names) AS (
  SELECT doc_id, 0, '|' || array_to_string(ids, '||') || '|', []::VARCHAR[] FROM seqs
  UNION ALL SELECT doc_id, a.pos + 1, replace(rest, run, '-'), CASE WHEN contains(rest, run) AND NOT list_contains(names, license) THEN list_append(names, license) ELSE names END FROM applied a JOIN rules r ON r.pos = a.pos
)
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN (SELECT doc_id, names FROM applied WHERE pos = {len(licenses.RULES)}) USING (doc_id)
"""


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=10, k=5)
    ids = F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(table(spark, folder, "documents"), threshold=0.8, k=5)
    return out.select("doc_id", "class_id", "class_docs")


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
  ) GROUP BY ALL
), sizes AS (SELECT doc_id, sum(c) AS total FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 10 * o >= 8 * (p.total + q.total - o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_docs FROM classes
"""


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup(table(spark, folder, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, r.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "conversations"))


_NEVER = "struct_pack(c := 1000000000000, a := '', r := []::VARCHAR[])"
_WAY = "struct_pack(c := v[{to}].c + {cost}, a := '{edit}' || v[{to}].a, r := {rows})"
_WITH = "list_prepend({role} || ':' || text, v[{to}].r)"
_NAMES = {"u": "'user'", "a": "'assistant'"}


def _ways(state: int) -> str:
    """The cheapest way to take a row in a state, in SQL; v has the ways after it, by state."""
    ways = [_WAY.format(to=state + 1, cost=4, edit="D", rows=f"v[{state + 1}].r")]
    for (at, initial), to in STEP.items():
        if at == state:
            keep = _WAY.format(to=to + 1, cost="extra", edit="K", rows=_WITH.format(role="role", to=to + 1))
            ways.append(f"CASE WHEN fault IN (1, 2) OR initial <> '{initial}' THEN {_NEVER} ELSE {keep} END")
    to = STEP[state, WANTED[state]] + 1
    again = _WAY.format(to=to, cost="3 + extra", edit="R", rows=_WITH.format(role=_NAMES[WANTED[state]], to=to))
    ways.append(f"CASE WHEN fault IN (1, 2) THEN {_NEVER} ELSE {again} END")
    return f"list_min([{', '.join(ways)}])"


def _inserted(state: int) -> str:
    to = STEP[state, WANTED[state]] + 1
    return f"list_min([v[{state + 1}], {_WAY.format(to=to, cost=3, edit='I', rows=f'list_prepend({_NAMES[WANTED[state]]} || chr(58), v[{to}].r)')}])"


_INSERTED = "[" + ", ".join(map(_inserted, range(4))) + "]"
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS k
  FROM conversations, crc
), dealt AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, rtrim(text, {_GAPS}) AS bare FROM dealt
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), walk(conv_id, i, v) AS (
  SELECT conv_id, n, (SELECT {_INSERTED} FROM (SELECT {_INSERTED} AS v FROM (SELECT [struct_pack(c := 0, a := '', r := []::VARCHAR[]), {_NEVER}, {_NEVER}, struct_pack(c := 0, a := '', r := []::VARCHAR[])] AS v))) FROM counted
  UNION ALL
  SELECT conv_id, i, {_INSERTED} FROM (
    SELECT conv_id, i, {_INSERTED} AS v FROM (
      SELECT w.conv_id, w.i - 1 AS i, [{", ".join(map(_ways, range(4)))}] AS v FROM walk w JOIN (SELECT *, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra FROM faults) f ON f.conv_id = w.conv_id AND f.i = w.i
    )
  )
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) b LEFT JOIN counted USING (conv_id) LEFT JOIN (SELECT * FROM walk WHERE i = 0) USING (conv_id)
"""


def op12_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard_components(table(spark, folder, "documents"), percent=80, k=5)
    return out.select("doc_id", "n_shingles", "component_id")


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""


def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment(table(spark, folder, "documents")).drop("text_hash")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_filters": op4_url_filters,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_license_scans": op6_license_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op6_license_scans": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_ngram_jaccard_join": OP12_SQL,
}
