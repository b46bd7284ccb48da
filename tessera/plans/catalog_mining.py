"""Named queries: market baskets, association rules, tokens and bigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import basket, text
from tessera.plans.registry import query
from tessera.sources.tables import load

# The stop words removed from product names and documents (our
# own list; the source analysis downloads an external corpus).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in",
              "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")
STOP_WORDS_BY_LANG = {
    "en": STOP_WORDS,
    "de": ("aber", "als", "am", "an", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine",
           "er", "es", "für", "im", "in", "ist", "mit", "nicht", "sich", "sie", "sind", "und", "von", "war", "zu", "zum", "zur"),
    "fr": ("au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne",
           "on", "ou", "par", "pas", "pour", "que", "qui", "se", "son", "sur", "un", "une"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "más", "no", "o", "para", "pero", "por",
           "que", "se", "su", "sus", "un", "una", "y"),
}

_ITEMS = ("click", "error", "purchase", "signup", "view")
_MIN_SUPPORT = 0.008


def event_baskets(spark, sf):
    """One basket per user and day; items are the event types seen (at least once)."""
    ev = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ev = ev.withColumn("basket_id", F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")))
    return basket.baskets(ev, "basket_id", "event_type")


_MASK_SQL = """
WITH b AS (SELECT user_id, CAST(ts AS DATE) AS d, """ + " + ".join(
    f"max(CASE WHEN event_type = '{it}' THEN {1 << i} ELSE 0 END)" for i, it in enumerate(_ITEMS)) + """ AS mask
           FROM events GROUP BY 1, 2),
nb AS (SELECT count(*) AS n FROM b),
s AS (SELECT m, count_if((b.mask & m) = m) AS freq FROM b, range(1, 32) t(m) GROUP BY m),
f AS (SELECT m, CAST(freq AS BIGINT) AS freq, freq / n AS support FROM s, nb WHERE freq / n >= """ + str(_MIN_SUPPORT) + ")"


def _key_sql(m: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({m} & {1 << i}) > 0 THEN '{it}' END"
                                         for i, it in enumerate(_ITEMS)) + ")"


@query("basket_sizes", "B3 X14", sql="""
WITH b AS (SELECT user_id, CAST(ts AS DATE) AS d, count(DISTINCT event_type) AS k FROM events GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS n_items, count(*) AS n_baskets FROM b GROUP BY 1""")
def basket_sizes(spark, sf):
    return (event_baskets(spark, sf).groupBy(F.size("items").alias("n_items"))
            .agg(F.count(F.lit(1)).alias("n_baskets")))


@query("itemsets", "B4", sql=_MASK_SQL + f"""
SELECT {_key_sql('m')} AS items, freq, round(support, 8) AS support FROM f""")
def itemsets(spark, sf):
    fi = basket.frequent_itemsets(event_baskets(spark, sf), _MIN_SUPPORT)
    return fi.select(F.array_join("items", ",").alias("items"), "freq", F.round("support", 8).alias("support"))


@query("rules", "B5", sql=_MASK_SQL + f""",
r AS (SELECT fa.m AS a, fc.m AS c, fs.support AS s, fa.support AS sa, fc.support AS sc
      FROM f fs JOIN f fa ON (fa.m & fs.m) = fa.m AND fa.m <> fs.m
                JOIN f fc ON fc.m = fs.m - fa.m)
SELECT {_key_sql('a')} AS antecedents, {_key_sql('c')} AS consequents, round(s, 8) AS support,
       round(s / sa, 8) AS confidence, round(s / sa / sc, 8) AS lift, round(s - sa * sc, 8) AS leverage,
       round(CASE WHEN s / sa < 1 THEN (1 - sc) / (1 - s / sa) END, 6) AS conviction
FROM r WHERE s / sa / sc >= 0.8""")
def rules(spark, sf):
    fi = basket.frequent_itemsets(event_baskets(spark, sf), _MIN_SUPPORT)
    r = basket.association_rules(fi, "lift", 0.8)
    return r.select(F.array_join("antecedents", ",").alias("antecedents"),
                    F.array_join("consequents", ",").alias("consequents"),
                    *[F.round(c, 8).alias(c) for c in ("support", "confidence", "lift", "leverage")],
                    F.round("conviction", 6).alias("conviction"))


@query("rule_matrix", "B6 B7 A8", sql=_MASK_SQL + f""",
r AS (SELECT fa.m AS a, fc.m AS c, fs.support AS s, fa.support AS sa, fc.support AS sc
      FROM f fs JOIN f fa ON (fa.m & fs.m) = fa.m AND fa.m <> fs.m
                JOIN f fc ON fc.m = fs.m - fa.m)
SELECT replace({_key_sql('a')}, ',', ', ') AS antecedent, replace({_key_sql('c')}, ',', ', ') AS consequent,
       round(s / sa, 8) AS confidence
FROM r WHERE s / sa / sc >= 0.8 AND s / sa > 0.3""")
def rule_matrix(spark, sf):
    fi = basket.frequent_itemsets(event_baskets(spark, sf), _MIN_SUPPORT)
    strong = basket.strong_rules(basket.association_rules(fi, "lift", 0.8), 0.3)
    return basket.rule_matrix(strong).withColumn("confidence", F.round("confidence", 8))


_BRAND_SQL = f"""
WITH lp AS (SELECT l_orderkey AS o, p_brand AS b, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
nb AS (SELECT count(DISTINCT o) AS n FROM lp),
ob AS (SELECT o, b FROM lp GROUP BY 1, 2 HAVING sum(q) >= 1),
f1 AS (SELECT b AS a1, count(*) / n AS sup FROM ob, nb GROUP BY 1, n HAVING count(*) / n >= {_MIN_SUPPORT}),
f2 AS (SELECT x.b AS a1, y.b AS a2, count(*) / n AS sup FROM ob x JOIN ob y ON x.o = y.o AND x.b < y.b, nb
       GROUP BY 1, 2, n HAVING count(*) / n >= {_MIN_SUPPORT}),
f3 AS (SELECT x.b AS a1, y.b AS a2, z.b AS a3, count(*) / n AS sup
       FROM ob x JOIN ob y ON x.o = y.o AND x.b < y.b JOIN ob z ON z.o = x.o AND y.b < z.b, nb
       GROUP BY 1, 2, 3, n HAVING count(*) / n >= {_MIN_SUPPORT}),
sets AS (SELECT a1 AS k, sup FROM f1 UNION ALL SELECT a1 || ',' || a2, sup FROM f2
         UNION ALL SELECT a1 || ',' || a2 || ',' || a3, sup FROM f3),
r AS (SELECT a1 AS a, a2 AS c, sup FROM f2 UNION ALL SELECT a2, a1, sup FROM f2
      UNION ALL SELECT a1, a2 || ',' || a3, sup FROM f3 UNION ALL SELECT a2, a1 || ',' || a3, sup FROM f3
      UNION ALL SELECT a3, a1 || ',' || a2, sup FROM f3 UNION ALL SELECT a1 || ',' || a2, a3, sup FROM f3
      UNION ALL SELECT a1 || ',' || a3, a2, sup FROM f3 UNION ALL SELECT a2 || ',' || a3, a1, sup FROM f3),
m AS (SELECT r.a, r.c, r.sup, sa.sup AS sa, sc.sup AS sc FROM r JOIN sets sa ON sa.k = r.a JOIN sets sc ON sc.k = r.c)
SELECT a AS antecedents, c AS consequents, round(sup, 8) AS support, round(sup / sa, 8) AS confidence,
       round(sup / sa / sc, 8) AS lift FROM m WHERE sup / sa / sc >= 0.8"""


@query("brand_rules", "B3 B4 B5 J1", sql=_BRAND_SQL)
def brand_rules(spark, sf):
    """Brands bought together in one order (quantity >= 1), rules from every frequent set.
    The SQL twin enumerates sets of up to three brands, enough for this data
    (the Spark side has no size limit)."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = load(spark, sf, "part").select("p_partkey", "p_brand")
    lines = li.join(p, li.l_partkey == p.p_partkey)
    bk = basket.baskets(lines, "l_orderkey", "p_brand", "l_quantity")
    fi = basket.frequent_itemsets(bk, _MIN_SUPPORT)
    r = basket.association_rules(fi, "lift", 0.8)
    return r.select(F.array_join("antecedents", ",").alias("antecedents"),
                    F.array_join("consequents", ",").alias("consequents"),
                    *[F.round(c, 8).alias(c) for c in ("support", "confidence", "lift")])


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOK_SQL = ("list_filter(string_split_regex(trim(lower(regexp_replace({c}, '[^a-zA-Z]', ' ', 'g'))), '\\s+'), "
            "lambda w: w <> '' AND NOT list_contains(" + _STOP_SQL + ", w))")


@query("tokens", "B1 X6", sql=f"""
SELECT token, count(*) AS n FROM (SELECT unnest({_TOK_SQL.format(c='p_name')}) AS token FROM part) GROUP BY token""")
def tokens(spark, sf):
    t = text.tokenize(load(spark, sf, "part"), "p_name", stop_words=STOP_WORDS)
    return text.token_counts(t)


_BIGRAM_SQL = """
WITH t AS (SELECT {key} AS k, {tok} AS tokens FROM {table} {where}),
p AS (SELECT unnest(tokens[1:len(tokens) - 1]) AS first, unnest(tokens[2:len(tokens)]) AS second
      FROM t WHERE len(tokens) >= 2){extra}
SELECT first, second, count(*) AS n FROM p GROUP BY 1, 2"""


@query("bigrams", "B2 W4", sql=_BIGRAM_SQL.format(key="p_partkey", tok=_TOK_SQL.format(c="p_name"), table="part",
                                                 where="", extra=""))
def bigrams(spark, sf):
    t = text.tokenize(load(spark, sf, "part"), "p_name", stop_words=STOP_WORDS)
    return text.bigram_counts(t)


@query("bigrams_cross", "B2 W4 D18", sql=_BIGRAM_SQL.format(
    key="p_partkey", tok=_TOK_SQL.format(c="p_name"), table="part", where="", extra=""",
ne AS (SELECT k, tokens[1] AS f, tokens[len(tokens)] AS l FROM t WHERE len(tokens) >= 1),
x AS (SELECT l AS first, lead(f) OVER (ORDER BY k) AS second FROM ne),
p2 AS (SELECT * FROM p UNION ALL SELECT * FROM x WHERE second IS NOT NULL)""").replace(
    "FROM p GROUP BY", "FROM p2 GROUP BY"))
def bigrams_cross(spark, sf):
    t = text.tokenize(load(spark, sf, "part"), "p_name", stop_words=STOP_WORDS)
    return text.bigram_counts(t, key="p_partkey", cross_boundary=True)


@query("doc_bigrams", "B1 B2 W4", sql="""
SELECT * FROM (""" + _BIGRAM_SQL.format(key="doc_id", tok=_TOK_SQL.format(c="text"), table="documents",
                                        where="WHERE lang = 'en'", extra="") + """)
ORDER BY n DESC, first, second LIMIT 50""")
def doc_bigrams(spark, sf):
    """The 50 most frequent bigrams over whole English documents (a top-k report)."""
    docs = load(spark, sf, "documents").where(F.col("lang") == "en")
    t = text.tokenize(docs, "text", stop_words=STOP_WORDS)
    return text.bigram_counts(t).orderBy(F.desc("n"), "first", "second").limit(50)


_LANG_STOPS_SQL = "CASE lang " + " ".join(
    f"WHEN '{g}' THEN [" + ", ".join(f"'{w}'" for w in ws) + "]" for g, ws in STOP_WORDS_BY_LANG.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_LETTERS = r"\p{L}\p{M}"


@query("doc_bigrams_all", "B1 B2 W4", sql=_BIGRAM_SQL.format(
    key="doc_id", table="documents", where="", extra="",
    tok=f"list_filter(string_split_regex(trim(lower(regexp_replace(text, '[^{_LETTERS}]', ' ', 'g'))), '\\s+'), "
        f"lambda w: w <> '' AND NOT list_contains({_LANG_STOPS_SQL}, w))"))
def doc_bigrams_all(spark, sf):
    """Every bigram of all documents, of any language or none, with the stop words of its language."""
    t = text.tokenize(load(spark, sf, "documents"), "text", stop_words=STOP_WORDS_BY_LANG, lang="lang", letters=_LETTERS)
    return text.bigram_counts(t)
