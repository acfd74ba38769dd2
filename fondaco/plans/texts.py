"""Queries of the text functions over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fondaco.functions import legal, similarity as sim, text as tx
from fondaco.session import table

# SQL twins of the column functions; RE2 takes \1 where Java takes $1.
W = tx.W


def _sub(sql: str, pattern: str, by: str) -> str:
    by = by.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def sql_chain(sql: str, steps) -> str:
    for pattern, by in steps:
        sql = _sub(sql, pattern, by)
    return sql


def sql_squeeze(sql: str) -> str:
    return sql_chain(sql, [(r"\s+", " "), (r"^ | $", "")])


def sql_clean(sql: str) -> str:
    return f"coalesce({sql_chain(sql, tx.CLEANING)}, '')"


def sql_hash_form(sql: str) -> str:
    return sql_squeeze(_sub(f"lower({sql_clean(sql)})", r"[^\p{L}\p{N}_\s]", ""))


def sql_words(sql: str) -> str:
    return f"list_filter(string_split_regex(lower({sql}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def sql_shingles(words: str, n: int) -> str:
    runs = ", ' ', ".join(f"({words})[i + {k}]" for k in range(n))
    return f"list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: concat({runs})))"


def sql_trigrams(sql: str) -> str:
    return f"list_distinct(flatten(list_transform({sql_words(sql)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def sql_share(sql: str, pattern: str) -> str:
    return f"CASE WHEN length({sql}) > 0 THEN (length({sql}) - length({_sub(sql, pattern, '')}))::DOUBLE / length({sql}) ELSE 0.0 END"


def sql_article_number(sql: str) -> str:
    return f"try_cast(nullif(regexp_extract(lower({sql}), '(\\d+)', 1), '') AS INT)"


def sql_article_suffix(sql: str) -> str:
    names = "|".join(sorted(legal.SUFFIXES, key=len, reverse=True))
    return f"nullif(regexp_extract(lower({sql}), '\\d\\s*(?:-\\s*)?({names})\\b', 1), '')"


def sql_ordinal(sql: str) -> str:
    names = ", ".join(f"'{s}'" for s in legal.SUFFIXES)
    return f"CASE WHEN coalesce({sql}, '') = '' THEN 0 WHEN list_position([{names}], lower({sql})) > 0 THEN list_position([{names}], lower({sql}))::INT + 1 ELSE 99 END"


def sql_sort_key(sql: str) -> str:
    return f"CASE WHEN {sql_article_number(sql)} IS NULL THEN '999999.99' ELSE lpad({sql_article_number(sql)}::VARCHAR, 6, '0') || '.' || lpad(({sql_ordinal(sql_article_suffix(sql))})::VARCHAR, 2, '0') END"


QUERIES, SQL = {}, {}


def _over(name: str, source: str, keys: list[str], columns: Callable[[], dict], sql: dict[str, str], where: str = "true"):
    """Register a projection of whole columns: Spark expressions and their SQL under the same names."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).where(where).select(*keys, *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = query
    if sql:
        SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM {source} WHERE {where}"


_over("clean_legal_text", "massime", ["id"], lambda: {"clean": tx.clean_legal_text(F.col("testo"))}, {"clean": sql_clean("testo")})
_over("normalize_for_hash", "massime", ["id"], lambda: {"normal": tx.normalize_for_hash(F.col("testo"))}, {"normal": sql_hash_form("testo")})
_over("normalize_simple", "massime", ["id"], lambda: {"normal": tx.normalize_simple(F.col("testo"))}, {"normal": sql_chain("lower(testo)", [(r"\s+", " "), (r"[^\p{L}\p{N}_\s]", ""), ("^ +| +$", "")])})
_over("normalize_citation", "massime", ["id"], lambda: {"normal": tx.normalize_citation(F.col("testo"))}, {"normal": sql_squeeze(_sub("lower(testo)", r"[^\p{L}\p{N}_\s]", " "))})
_over("normalize_chunking", "documents", ["doc_id"], lambda: {"normal": tx.normalize_chunking(F.col("text"))}, {"normal": sql_chain("translate(text, chr(8217) || chr(8216) || chr(8220) || chr(8221) || chr(160), '''''\"\" ')", [(r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")])})
_over("normalize_v2", "documents", ["doc_id"], lambda: {"normal": tx.normalize_v2(F.col("text"))}, {})
_over("nfc_texts", "documents", ["doc_id"], lambda: {"composed": tx.nfc(F.col("text"))}, {"composed": "nfc_normalize(text)"})
_over("fix_encoding", "documents", ["doc_id"], lambda: {"fixed": F.translate("text", "’‘“”–— ", "''\"\"-- ")}, {"fixed": "translate(text, '’‘“”–—' || chr(160), '''''\"\"-- ')"})
_over("clean_ocr", "massime", ["id"], lambda: {"clean": tx.clean_ocr(F.col("testo"))}, {})
_n = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))::DOUBLE"
_letters, _pairs, _runs = _n(tx.LETTER), _n(rf"{tx.LETTER}\s{tx.LETTER}"), _n(f"{tx.LETTER}+")
_factor = "CASE " + " ".join(f"WHEN {_pairs} / {_letters} > {least} AND {_letters} / {_runs} < {most} THEN {f}" for least, most, f in tx.SPACED) + " ELSE 0.0 END"
_spaced = f"CASE WHEN text IS NULL OR length(text) < {tx.SHORT} OR {_letters} = 0 THEN 0.0 ELSE round(least(1.0, least(1.0, {_pairs} / {_letters} * {_factor}) * CASE WHEN {_n(' ')} / length(text) > {tx.BLANKS} THEN {tx.RAISED} ELSE 1.0 END), 4) END::DOUBLE"
_over("spaced_letters_score", "documents", ["doc_id"], lambda: {"score": tx.spaced_letters_score(F.col("text"))}, {"score": _spaced})
_close = f"regexp_replace({{0}}, '({tx.LETTER})\\s({tx.LETTER})', '\\1\\2', 'g')"
_over("safe_despace", "documents", ["doc_id"], lambda: {"despaced": tx.safe_despace(F.col("text"))}, {"despaced": f"CASE WHEN length(text) >= 20 AND {_spaced} >= 0.12 THEN {_close.format(_close.format('text'))} ELSE text END"})
_over("unaccent_voce", "normativa", ["id"], lambda: {"voce": tx.unaccent(F.col("rubrica"))}, {"voce": f"translate(lower(rubrica), '{tx.ACCENTS[0]}', '{tx.ACCENTS[1]}')"})
_over(
    "content_hash", "massime", ["id"], lambda: {f"hash{n}": tx.content_hash(tx.normalize_for_hash(F.col("testo")), n) for n in (64, 40, 32, 16)},
    {f"hash{n}": f"substring(sha256({sql_hash_form('testo')}), 1, {n})" for n in (64, 40, 32, 16)},
)
_over(
    "content_hash_composite", "normativa_vigenza", ["id"],
    lambda: {"delta_key": F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("testo", "opendata_version", "inizio_vigore", "fine_vigore")]), 256)},
    {"delta_key": "sha256(concat_ws('|', testo, opendata_version, coalesce(inizio_vigore::VARCHAR, ''), coalesce(fine_vigore::VARCHAR, '')))"},
)
_over("first_sentence", "massime", ["id"], lambda: {"tema": tx.first_sentence(F.col("testo"))}, {
    "tema": r"""CASE WHEN testo IS NULL THEN '' WHEN regexp_extract(testo, '[Ii]n tema di\s+([^,.]+)', 1) <> ''
    THEN 'In tema di ' || regexp_replace(regexp_extract(testo, '[Ii]n tema di\s+([^,.]+)', 1), '^\s+|\s+$', '', 'g')
    ELSE substring(regexp_replace(regexp_extract(testo, '^([^.!?]*)', 1), '^\s+|\s+$', '', 'g'), 1, 200) END"""
})
_over("token_estimate", "normativa_chunk", ["id", "created_at"], lambda: {"tokens": tx.token_estimate(F.col("text"))}, {"tokens": "greatest(1, length(text) // 4)::INT"})
_over(
    "chars_ratio_metrics", "massime", ["id"],
    lambda: {"valid": F.round(tx.share_of(F.col("testo"), r"[\p{L}\p{N}\s.,;:()'\"-]"), 6), "marks": F.round(tx.share_of(F.col("testo"), r"[^\p{L}\p{N}\s]"), 6), "italian": F.round(tx.italian_share(F.col("testo")), 6)},
    {
        "valid": f"round({sql_share('testo', chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's.,;:()' + chr(39) + chr(34) + '-]')}, 6)",
        "marks": "round(" + sql_share("testo", r"[^\p{L}\p{N}\s]") + ", 6)",
        "italian": f"round(CASE WHEN len({sql_words('testo')}) > 0 THEN len(list_filter({sql_words('testo')}, lambda x: x IN ({', '.join(chr(39) + w + chr(39) for w in tx.ITALIAN)})))::DOUBLE / len({sql_words('testo')}) ELSE 0.0 END, 6)",
    },
    "testo IS NOT NULL",
)
_over("html_strip_regex", "documents", ["doc_id"], lambda: {"plain": tx.strip_html(F.col("text"))}, {
    "plain": sql_chain("text", [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|tr)>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n\n"), (r"^\s+|\s+$", "")])
})


def header_footer_test(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of massime that look like page headers or footers, counted by form."""
    lines = table(spark, sf, "massime").select(F.explode(F.split("testo", "\n")).alias("line"))
    return lines.where(tx.is_header_or_footer(F.col("line"))).groupBy(F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#").alias("form")).agg(F.count("*").alias("n"))


QUERIES["header_footer_test"] = header_footer_test
SQL["header_footer_test"] = rf"""
    WITH lines AS (SELECT unnest(string_split(testo, chr(10))) AS line FROM massime)
    SELECT regexp_replace(lower(trim(line)), '\d+', '#', 'g') AS form, count(*) AS n FROM lines
    WHERE length(line) BETWEEN 1 AND 200 AND regexp_matches(lower(regexp_replace(line, '^\s+|\s+$', '', 'g')), '^({"|".join(tx.HEADERS)})') GROUP BY 1"""


def simhash64_chars(spark: SparkSession, sf: str) -> DataFrame:
    return sim.simhash_characters(table(spark, sf, "massime").select("id", tx.normalize_for_hash(F.col("testo")).alias("text")))


def simhash_words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "massime").where("testo is not null").select("id", tx.words(F.col("testo")).alias("w"))
    return sim.simhash(words, "id", sim.shingles(F.col("w"), 3), high=False)


def _sql_simhash(features: str, source: str, half: int) -> str:
    # Votes per bit, then the bits of positive votes summed; bit 63 is the sign.
    return f"""
        WITH f AS (SELECT id, {features} AS g FROM {source}),
        h AS (SELECT id, unnest(g) AS x FROM f),
        v AS (SELECT id, i, sum(CASE WHEN (('0x' || substring(md5(x), {half} + 12 - 4 * (i // 16), 4))::INT >> (i % 16)) & 1 = 1 THEN 1 ELSE -1 END) AS s
            FROM h, range(64) r(i) GROUP BY id, i)
        SELECT id, sum(CASE WHEN s <= 0 THEN 0::HUGEINT WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::INT) END)::BIGINT AS fingerprint FROM v GROUP BY id"""


QUERIES["simhash64_chars"] = simhash64_chars
SQL["simhash64_chars"] = _sql_simhash("list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))", f"(SELECT id, {sql_hash_form('testo')} AS t FROM massime WHERE length({sql_hash_form('testo')}) >= 3)", 1)
QUERIES["simhash_words"] = simhash_words
SQL["simhash_words"] = _sql_simhash(sql_shingles("w", 3), f"(SELECT id, {sql_words('testo')} AS w FROM massime WHERE testo IS NOT NULL)", 17)


def hamming_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Bits by which the stored fingerprint differs from that of the sentence's first words; a missing one differs in all."""
    rows = table(spark, sf, "massime")
    return rows.select("id", sim.hamming(F.col("text_fingerprint"), F.lit(0).cast("long")).alias("distance"), F.round(sim.simhash_similarity(F.col("text_fingerprint"), F.lit(0).cast("long")), 6).alias("similarity"))


QUERIES["hamming"] = hamming_stored
SQL["hamming"] = "SELECT id, coalesce(bit_count(text_fingerprint), 64)::INT AS distance, round(1 - coalesce(bit_count(text_fingerprint), 64) / 64.0, 6)::DOUBLE AS similarity FROM massime"


def similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Word, shingle and character-gram Jaccard between altalex articles and the rows an earlier load matched them to."""
    a = table(spark, sf, "normativa_altalex").select(F.col("id").alias("a"), "brocardi_match_id", F.col("testo").alias("ta")).where("brocardi_match_id is not null")
    b = table(spark, sf, "normativa").select(F.col("id").alias("brocardi_match_id"), F.col("testo").alias("tb"))
    wa, wb = tx.words(F.col("ta")), tx.words(F.col("tb"))
    return a.join(b, "brocardi_match_id").select(
        "a", F.round(sim.jaccard(F.array_distinct(wa), F.array_distinct(wb)), 6).alias("tokens"), F.round(sim.jaccard(sim.shingles(wa, 3), sim.shingles(wb, 3)), 6).alias("shingles"),
        F.round(sim.jaccard(sim.character_grams(F.lower("ta"), 3), sim.character_grams(F.lower("tb"), 3)), 6).alias("grams"),
        F.round(sim.jaccard(sim.trigrams(F.col("ta")), sim.trigrams(F.col("tb"))), 6).alias("trgm"),
    )


QUERIES["jaccard_similarities"] = similarities
_grams = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring(lower({0}), i, 3)))"
SQL["jaccard_similarities"] = f"""
    WITH p AS (SELECT a.id AS a, a.testo AS ta, b.testo AS tb, {sql_words('a.testo')} AS wa, {sql_words('b.testo')} AS wb FROM normativa_altalex a JOIN normativa b ON a.brocardi_match_id = b.id),
    s AS (SELECT a, wa, wb, {sql_shingles('wa', 3)} AS sa, {sql_shingles('wb', 3)} AS sb, {_grams.format('ta')} AS ga, {_grams.format('tb')} AS gb, {sql_trigrams('ta')} AS pa, {sql_trigrams('tb')} AS pb FROM p)
    SELECT a, round({sql_jaccard('wa', 'wb')}, 6) AS tokens, round({sql_jaccard('sa', 'sb')}, 6) AS shingles, round({sql_jaccard('ga', 'gb')}, 6) AS grams, round({sql_jaccard('pa', 'pb')}, 6) AS trgm FROM s"""

_over(
    "norm_citation_keys", "massime", ["id"], lambda: {"numero_n": legal.norm_numero(F.col("numero")), "rv_n": legal.norm_rv(F.col("rv")), "sezione_n": legal.norm_sezione(F.col("sezione"))},
    {
        "numero_n": "CASE WHEN numero <> '' AND regexp_replace(numero, '^0+', '') = '' THEN '0' ELSE regexp_replace(numero, '^0+', '') END",
        "rv_n": r"CASE WHEN regexp_extract(rv, '^0*(\d{5,7})', 1) <> '' THEN regexp_extract(rv, '^0*(\d{5,7})', 1) ELSE rv END",
        "sezione_n": "CASE WHEN lower(trim(sezione)) IN ('un', 'unite', 'u') THEN 'U' WHEN lower(trim(sezione)) IN ('lav', 'l') THEN 'L' ELSE trim(sezione) END",
    },
)
_over("roman_to_int", "normativa", ["id"], lambda: {"libro_n": legal.roman_value(F.regexp_extract("libro", r"([IVX]+)$", 1)), "titolo_n": legal.roman_value(F.regexp_extract("titolo", r"([IVX]+)$", 1))}, {
    f"{c}_n": f"nullif(coalesce(list_position([{', '.join(chr(39) + r + chr(39) for r in legal.ROMANS)}], regexp_extract({c}, '([IVX]+)$', 1)), 0), 0)::INT" for c in ("libro", "titolo")
})
SQL["roman_to_int"] = SQL["roman_to_int"].replace("SELECT id, nullif(", "SELECT id, CASE WHEN libro IS NOT NULL THEN nullif(").replace("::INT AS libro_n", "::INT END AS libro_n").replace(" nullif(coalesce(list_position([", " nullif(coalesce(list_position([")
_over(
    "parse_article_number", "normativa_altalex", ["id"], lambda: {"base": legal.article_number(F.col("articolo")), "suffix": legal.article_suffix(F.col("articolo")), "kind": legal.article_identity(F.col("articolo"))},
    {"base": sql_article_number("articolo"), "suffix": sql_article_suffix("articolo"), "kind": f"CASE WHEN {sql_article_number('articolo')} IS NULL THEN 'SPECIAL' WHEN {sql_article_suffix('articolo')} IS NOT NULL THEN 'SUFFIX' ELSE 'BASE' END"},
)
_over("sort_natural_article", "normativa", ["id"], lambda: {"sort_key": legal.article_sort_key(F.col("articolo"))}, {"sort_key": sql_sort_key("articolo")})
_art = f"{sql_article_number('articolo')}::VARCHAR || coalesce({sql_article_suffix('articolo')}, '')"
_over(
    "build_urn", "normativa", ["id"], lambda: {"urn": legal.article_urn(F.concat(F.lit("urn:nir:stato:act:"), F.col("work_id").cast("string")), F.col("articolo"), F.lit(1)), "urn_tilde": legal.article_urn(F.concat(F.lit("urn:nir:stato:act:"), F.col("work_id").cast("string")), F.col("articolo"), F.lit(1), tilde=True)},
    {"urn": f"'urn:nir:stato:act:' || work_id || '~art' || {_art} || '-com1'", "urn_tilde": f"'urn:nir:stato:act:' || work_id || ':art' || {_art} || '~com1'"},
)


def parse_urns(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["build_urn"](spark, sf).select("id", legal.parse_urn(F.col("urn")).alias("p")).select("id", "p.*")


QUERIES["parse_urn"] = parse_urns
_urn = r"'^(urn:nir:[^~]+?)[~:]art(\d+)([a-z]*)(?:[-~]com(\d+))?$'"
SQL["parse_urn"] = f"""SELECT id, nullif(regexp_extract(urn, {_urn}, 1), '') AS base, nullif(regexp_extract(urn, {_urn}, 2), '')::INT AS article,
    nullif(regexp_extract(urn, {_urn}, 3), '') AS suffix, nullif(regexp_extract(urn, {_urn}, 4), '')::INT AS comma FROM ({SQL['build_urn']})"""
_over(
    "canonical_id", "normativa_altalex", ["id"],
    lambda: {"canonical": legal.canonical_id(F.upper("codice"), legal.article_number(F.col("articolo")).cast("string"), legal.article_suffix(F.col("articolo")), F.lit(None).cast("string"), F.lit(None).cast("int")), "global_key": legal.global_key(F.col("codice"), F.col("articolo"))},
    {"canonical": f"concat_ws(':', upper(codice), {sql_article_number('articolo')}::VARCHAR, {sql_article_suffix('articolo')})",
     "global_key": f"concat_ws(':', 'altalex', lower(codice), {sql_article_number('articolo')}::VARCHAR, coalesce({sql_article_suffix('articolo')}, 'null'))"},
    "upper(codice) NOT IN ('LEGGE', 'DLGS', 'DPR', 'DL')",
)
_over("celex_build", "work", ["id"], lambda: {"celex": legal.celex(F.lit("L"), F.year("atto_data"), F.col("atto_numero"))}, {"celex": "'3' || year(atto_data) || 'L' || lpad(atto_numero, 4, '0')"}, "length(atto_numero) <= 4")
_over(
    "date_parse", "normativa_vigenza", ["id"], lambda: {"snapshot": legal.compact_date(F.regexp_extract("opendata_version", r"(\d{4}-?\d{2}-?\d{2})$", 1)), "sentinel": legal.compact_date(F.lit("99999999"))},
    {"snapshot": r"coalesce(try_strptime(regexp_extract(opendata_version, '(\d{4}-?\d{2}-?\d{2})$', 1), '%Y%m%d'), try_strptime(regexp_extract(opendata_version, '(\d{4}-?\d{2}-?\d{2})$', 1), '%Y-%m-%d'))::DATE", "sentinel": "NULL::DATE"},
)
_over(
    "temporal_parse_query", "documents", ["doc_id"], lambda: {"year": legal.query_year(F.col("text")), "day": legal.italian_date(F.col("text"))},
    {"year": r"nullif(regexp_extract(text, '\b(20[0-2][0-9])\b', 1), '')::INT",
     "day": r"try_strptime(nullif(regexp_extract(text, '(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})', 0), ''), ['%d/%m/%Y', '%d.%m.%Y', '%d-%m-%Y'])::DATE"},
)
_over(
    "year_resolution", "massime", ["id"],
    lambda: {"year": F.coalesce(F.when(F.col("anno").between(1990, 2025), F.col("anno")), F.year("data_decisione"), F.nullif(F.regexp_extract("testo", r"/(\d{4})\b", 1), F.lit("")).cast("int")),
     "conflict": F.coalesce(F.col("anno") != F.year("data_decisione"), F.lit(False))},
    {"year": r"coalesce(CASE WHEN anno BETWEEN 1990 AND 2025 THEN anno END, year(data_decisione), nullif(regexp_extract(testo, '/(\d{4})\b', 1), '')::INT)::INT", "conflict": "coalesce(anno <> year(data_decisione), false)"},
)
_over("to_char_casts", "massime", ["id"], lambda: {"day": F.date_format("data_decisione", "dd/MM/yyyy"), "month": F.date_format("created_at", "yyyy-MM")}, {"day": "strftime(data_decisione, '%d/%m/%Y')", "month": "strftime(created_at, '%Y-%m')"})
_over("embed_channel_text", "massime", ["id"], lambda: {
    "testo_ch": F.coalesce("testo", F.lit("")), "tema_ch": tx.first_sentence(F.col("testo")),
    "contesto_ch": F.concat_ws(" | ", F.concat(F.lit("Sez. "), F.col("sezione")), F.col("materia"), F.col("anno").cast("string"), F.col("testo"))}, {
    "testo_ch": "coalesce(testo, '')", "tema_ch": SQL["first_sentence"].split("SELECT id, ")[1].split(" AS tema FROM")[0],
    "contesto_ch": "concat_ws(' | ', 'Sez. ' || sezione, materia, anno::VARCHAR, testo)"})
_over("normalize_source_compare", "normativa_altalex", ["id"], lambda: {"form": tx.squeeze(F.regexp_replace(tx.unaccent(F.col("testo")), "[’‘`]", "'"))}, {"form": sql_squeeze(_sub(f"translate(lower(testo), '{tx.ACCENTS[0]}', '{tx.ACCENTS[1]}')", "[’‘`]", "'"))})
_over("cosine_and_norm", "normativa_chunk_embeddings", ["id"], lambda: {"norm": F.round(sim.norm(F.col("embedding")), 5), "self_cosine": F.round(sim.cosine(F.col("embedding"), F.col("embedding")), 5)}, {
    "norm": "round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5)",
    "self_cosine": "CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) END"},
    "embedding IS NOT NULL AND NOT array_contains(embedding, cast('NaN' AS FLOAT))")
SQL["cosine_and_norm"] = SQL["cosine_and_norm"].replace("NOT array_contains(embedding, cast('NaN' AS FLOAT))", "NOT list_contains(embedding, 'NaN'::FLOAT)")
_over("l2_normalize", "normativa_chunk_embeddings", ["id"], lambda: {"size": F.size(sim.l2_normalize(F.col("embedding")))}, {
    "size": "CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN len(embedding) END"}, "embedding IS NOT NULL AND NOT array_contains(embedding, cast('NaN' AS FLOAT))")
SQL["l2_normalize"] = SQL["l2_normalize"].replace("NOT array_contains(embedding, cast('NaN' AS FLOAT))", "NOT list_contains(embedding, 'NaN'::FLOAT)")
_over("embed_validate_dims", "normativa_chunk_embeddings", ["id"], lambda: {"valid": F.coalesce(F.size("embedding") == F.col("dims"), F.lit(False))}, {"valid": "coalesce(len(embedding) = dims, false)"})
