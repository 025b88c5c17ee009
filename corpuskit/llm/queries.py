"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import bpe, counts, decontaminate, html_text, language, lines, merkle, packing, phrases, pii, quality, simhash, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_OP4 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS five FROM w, unnest(range(1, len(ws) - 3)) u(i)),
  r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, five) AS c FROM g) WHERE c > 1) GROUP BY rid),
  m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
  h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k FROM b WHERE source IS NOT NULL GROUP BY source),
  q AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS v FROM h),
  x AS (SELECT source, CASE WHEN v > 0 THEN (k + mean * greatest(mean * (1 - mean) / v - 1, 1e-6)) / (n + greatest(mean * (1 - mean) / v - 1, 1e-6)) ELSE mean END > 0.5 AS bad FROM h, q)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM b LEFT JOIN x USING (source)"""


@_query("op4_quality_rules", _OP4)
def op4(spark, folder):
    docs = _table(spark, folder, "documents")
    return quality.judge(docs, keep=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept")


@_query("op5_bpe")
def op5(spark, folder):
    return bpe.token_digests(_table(spark, folder, "documents"))


@_query("op8_simhash")
def op8(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def _words_sql(c: str) -> str:
    low = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP10 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("coalesce(text, '')")} AS ws FROM documents),
  b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {_words_sql("coalesce(text, '')")} AS ws FROM benchmark) WHERE len(ws) > 0),
  bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM b, unnest(range(1, len(ws) - k + 2)) u(i)),
  dw AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM b), unnest(range(1, len(ws) - k + 2)) u(i)),
  hit AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, win)),
  pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
  its AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS s FROM hit GROUP BY rid)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


@_query("op10_decontaminate", _OP10)
def op10(spark, folder):
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("matches")


@_query("op1_html_extraction")
def op1(spark, folder):
    return html_text.extract(_table(spark, folder, "pages"), keep=["page_id", "url"])


@_query("op2_pack_tokens")
def op2(spark, folder):
    return packing.pack(_table(spark, folder, "documents"))


@_query("op3_language_id")
def op3(spark, folder):
    return language.identify(_table(spark, folder, "documents"))


@_query("op6_token_counts")
def op6(spark, folder):
    return counts.edited_counts(_table(spark, folder, "documents"))


@_query("op7_personal_data")
def op7(spark, folder):
    return pii.personal_data(_table(spark, folder, "documents"))


_OP9 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(text) AS k, string_split(text, chr(10)) AS ls FROM documents),
  f AS (SELECT rid, doc_id, k, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'pos': i, 'w': len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')), 't': regexp_replace(ls[i], '^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$', '', 'g')}), lambda x: x.w > 0) AS fl FROM d),
  g AS (SELECT rid, doc_id, k, fl, i, list_min(list_filter(range(1, 51), lambda n: i + n - 1 <= len(fl) AND list_sum(list_transform(fl[i:i + n - 1], lambda x: x.w)) >= 50)) AS n,
    list_min(list_filter(range(1, 51), lambda n: n <= i AND list_sum(list_transform(fl[i - n + 1:i], lambda x: x.w)) >= 50)) AS m FROM f, unnest(range(1, len(fl) + 1)) u(i)),
  h AS (SELECT DISTINCT rid, doc_id, k, a, b, fl[a].pos AS first, fl[b].pos AS last, array_to_string(list_transform(fl[a:b], lambda x: x.t), chr(10)) AS body
    FROM (SELECT *, i AS a, i + n - 1 AS b FROM g WHERE n IS NOT NULL UNION ALL SELECT *, i - m + 1 AS a, i AS b FROM g WHERE m IS NOT NULL)),
  p AS (SELECT rid, doc_id, k, first, last, body FROM h),
  o AS (SELECT body, arg_min({'doc_id': doc_id, 'k': k, 'first': first, 'last': last}, (doc_id IS NULL, doc_id, k, first)) AS o FROM p GROUP BY body),
  l AS (SELECT DISTINCT rid, unnest(range(first, last + 1)) AS pos FROM p JOIN o USING (body) WHERE NOT (p.doc_id IS NOT DISTINCT FROM o.o.doc_id AND p.k = o.o.k) OR p.first > o.o.last),
  z AS (SELECT rid, list(pos) AS gone FROM l GROUP BY rid)
  SELECT doc_id, t AS text, n_removed, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, coalesce(len(gone), 0)::BIGINT AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END AS t FROM d LEFT JOIN z USING (rid))"""


@_query("op9_line_dedup", _OP9)
def op9(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def _h(*parts: str) -> str:
    return f"sha256({' || '.join(parts)})"


_ENC = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = [_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
#: CRC-32 of a decimal number, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, b:
  list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _levels(name: str, source: str, n: int) -> str:
    """Levels 0 to ``n`` of the trees per g over ``source`` (g, p, h): what is alone in its g stays as it is."""
    out = [f"{name}0 AS ({source})"]
    for i in range(n):
        out.append(f"""{name}{i + 1} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{i}) GROUP BY g, p // 8)""")
    return ",\n  ".join(out)


def _siblings(name: str, n: int, g: str, p: str) -> list[str]:
    """(left, right) of a node with group ``g`` and place ``p`` on each level, '' where it is alone."""
    out = []
    for i in range(n):
        run = f"FROM {name}{i} s WHERE s.g = {g} AND s.p // 8 = {p} // {8 ** (i + 1)}"
        for sign in "<>":
            out.append(f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.p) {run} AND s.p {sign} {p} // {8 ** i}), '')")
    return out


_DEEP, _WIDE = 7, 3
_ALONE = [f"(SELECT count(*) FROM a{i} s WHERE s.g = l.g) > 1" for i in range(_DEEP)] + [f"(SELECT count(*) FROM t{i}) > 1" for i in range(_WIDE)]
_PAIRS = _siblings("a", _DEEP, "l.g", "l.p") + _siblings("t", _WIDE, "1", "l.gp")
_FOLD = "list_reduce(list_concat([{'a': '', 'b': node, 'm': true}], path), lambda x, y: {'a': '', 'b': CASE WHEN y.m THEN sha256(y.a || x.b || y.b) ELSE x.b END, 'm': true}).b"
_OP11 = f"""WITH d AS (SELECT doc_id, coalesce('.' || lang, '') AS g, {_h(*_LEAF)} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_h(*_LEAF[:4], _ENC.format(_LOW))} END AS other FROM documents),
  l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, dense_rank() OVER (ORDER BY g) - 1 AS gp FROM d),
  {_levels("a", "SELECT g, p, leaf AS h FROM l", _DEEP)},
  {_levels("t", f"SELECT 1 AS g, row_number() OVER (ORDER BY g) - 1 AS p, h FROM a{_DEEP}", _WIDE)},
  w AS (SELECT doc_id, leaf, coalesce(other, leaf) AS node, (SELECT h FROM a{_DEEP} s WHERE s.g = l.g) AS subroot, (SELECT h FROM t{_WIDE}) AS root,
    [{", ".join(f"{{'a': {a}, 'b': {b}, 'm': {m}}}" for a, b, m in zip(_PAIRS[::2], _PAIRS[1::2], _ALONE, strict=True))}] AS path FROM l),
  f AS (SELECT *, {_FOLD} AS folded_root FROM w)
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


@_query("op11_merkle_manifest", _OP11)
def op11(spark, folder):
    return merkle.documents_manifest(_table(spark, folder, "documents"))


_OP12 = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
  p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM d)),
  w AS (SELECT pid, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM p),
  e AS (SELECT lang, word AS w1, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3, lead(word, 3) OVER x AS w4, lead(word, 4) OVER x AS w5 FROM w WINDOW x AS (PARTITION BY pid ORDER BY i)),
  g AS (SELECT lang, unnest([1, 2, 3, 4, 5]) AS k, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5]) AS phrase FROM e),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g WHERE phrase IS NOT NULL GROUP BY lang, k, phrase),
  t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 100),
  y AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS p1, array_to_string(ws[i + 1:], ' ') AS p2 FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM c) WHERE i < k),
  x AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= 100),
  s AS (SELECT y.lang, y.phrase, y.a, x1.a AS l, x2.a AS r, n, (1000::HUGEINT * y.a * n) // (x1.a::HUGEINT * x2.a) AS score, i
    FROM y JOIN x x1 ON x1.lang = y.lang AND x1.phrase = p1 JOIN x x2 ON x2.lang = y.lang AND x2.phrase = p2 JOIN t ON t.lang = y.lang),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
  o AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS more FROM c, unnest(range(2, 5)) x(j), unnest(range(1, 5)) u(i) WHERE j < k AND i + j - 1 <= k GROUP BY 1, 2),
  z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE more IS NULL OR 100 * more < 100 * b.a),
  q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z)
  SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q WHERE rank <= 2000"""


@_query("op12_phrase_mining", _OP12)
def op12(spark, folder):
    return phrases.collocations(_table(spark, folder, "documents"))


_OP13 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CASE WHEN list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS e FROM embeddings),
  k AS (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
  c AS (SELECT r.a, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.b GROUP BY r.a),
  n AS (SELECT a, count(*) AS n_links FROM k GROUP BY a)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c ON c.a = v.rid LEFT JOIN n ON n.a = v.rid"""


@_query("op13_embedding_dedup", _OP13)
def op13(spark, folder):
    return vectors.near_vectors(_table(spark, folder, "embeddings"))
