"""Web-search queries over the stored postings of all documents."""

import uuid

from pyspark.sql import functions as F

from foliant.functions import english as E
from foliant.operators import keyword as K
from foliant.operators.compare import shared_folder
from foliant.plans.registry import query, table


def _replaced(end: str, endings: dict[str, str]) -> str:
    return f"CASE {end} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in endings.items()) + " END"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def stems_sql(vocabulary: str) -> str:
    """SQL tables that end in stems (word, stem) of the table `vocabulary` (word)."""
    short, region, first = E.SHORT, E.REGION, E.FIRST_REGION
    doubled = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
    return f"""s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {vocabulary}),
 s1 AS (SELECT *, CASE WHEN regexp_matches(w, '{first}') THEN length(regexp_extract(w, '{first}')) ELSE length(w) END AS r1 FROM s0),
 s2 AS (SELECT *, r1 + CASE WHEN regexp_matches(substr(w, r1 + 1), '{region}') THEN length(regexp_extract(substr(w, r1 + 1), '{region}')) ELSE length(w) - r1 END AS r2 FROM s1),
 s3 AS (SELECT * REPLACE (CASE WHEN regexp_matches(w, 'sses$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '(ied|ies)$') THEN CASE WHEN length(w) > 4 THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END
   WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w) FROM s2),
 s4 AS (SELECT *, w IN ({_listed(E.KEPT_LATER)}) AS kept, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') AS x FROM s3),
 s5 AS (SELECT *, left(w, length(w) - length(x)) AS y FROM s4),
 s6 AS (SELECT * REPLACE (CASE WHEN kept OR x = '' THEN w WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(x) >= r1 THEN y || 'ee' ELSE w END WHEN NOT regexp_matches(y, '[aeiouy]') THEN w
   WHEN regexp_matches(y, '(at|bl|iz)$') THEN y || 'e' WHEN regexp_matches(y, '{doubled}') THEN left(y, length(y) - 1) WHEN r1 >= length(y) AND regexp_matches(y, '{short}') THEN y || 'e' ELSE y END AS w) FROM s5),
 s7 AS (SELECT * REPLACE (CASE WHEN kept THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w) FROM s6),
 s8 AS (SELECT * REPLACE (regexp_extract(w, '({E.longest_first(E.STEP_2)})$') AS x) FROM s7),
 s9 AS (SELECT * REPLACE (left(w, length(w) - length(x)) AS y) FROM s8),
 s10 AS (SELECT * REPLACE (CASE WHEN kept OR x = '' OR length(y) < r1 OR (x = 'ogi' AND right(y, 1) <> 'l') OR (x = 'li' AND NOT regexp_matches(y, '[cdeghkmnrt]$')) THEN w ELSE y || {_replaced("x", E.STEP_2)} END AS w) FROM s9),
 s11 AS (SELECT * REPLACE (regexp_extract(w, '({E.longest_first(E.STEP_3)})$') AS x) FROM s10),
 s12 AS (SELECT * REPLACE (left(w, length(w) - length(x)) AS y) FROM s11),
 s13 AS (SELECT * REPLACE (CASE WHEN kept OR x = '' OR length(y) < r1 OR (x = 'ative' AND length(y) < r2) THEN w ELSE y || {_replaced("x", E.STEP_3)} END AS w) FROM s12),
 s14 AS (SELECT * REPLACE (regexp_extract(w, '({E.longest_first(E.STEP_4)})$') AS x) FROM s13),
 s15 AS (SELECT * REPLACE (left(w, length(w) - length(x)) AS y) FROM s14),
 s16 AS (SELECT * REPLACE (CASE WHEN kept OR x = '' OR length(y) < r2 OR (x = 'ion' AND NOT regexp_matches(y, '[st]$')) THEN w ELSE y END AS w) FROM s15),
 s17 AS (SELECT * REPLACE (left(w, length(w) - 1) AS y) FROM s16),
 s18 AS (SELECT *, CASE WHEN kept THEN w WHEN right(w, 1) = 'e' AND (length(y) >= r2 OR (length(y) >= r1 AND NOT regexp_matches(y, '{short}'))) THEN y WHEN right(w, 2) = 'll' AND length(y) >= r2 THEN y ELSE w END AS z FROM s17),
 stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN word IN ({_listed(E.KEPT)}) THEN word ELSE coalesce({_replaced("word", E.OWN_STEMS)}, replace(z, 'Y', 'y')) END AS stem FROM s18)"""


_WORDS = f"""words AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)) WHERE word NOT IN ({_listed(E.STOP_WORDS)})),
 vocabulary AS (SELECT DISTINCT word FROM words), {stems_sql("vocabulary")},
 postings AS (SELECT stem AS term, doc_id, (list_sort(list(DISTINCT least(pos, 16383))))[1:256] AS positions FROM words JOIN stems USING (word) GROUP BY ALL)"""


def _any(terms: list[str]) -> str:
    """Rank of rows that hold lists t0, t1, ... of the terms' positions, or null."""
    parts = [f"coalesce(list_sum(list_transform(range(1, len(t{i}) + 1), lambda n: 0.1::DOUBLE / (n * n))) / 1.64493406685::DOUBLE, 0)" for i in range(len(terms))]
    return f"round(({' + '.join(parts)}) / {len(terms)}, 8)"


def _all(terms: list[str]) -> str:
    pairs = [(i, j) for i in range(len(terms)) for j in range(i)]
    weight = "sqrt(0.01::DOUBLE * CASE WHEN abs(p - q) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(p - q) / 1.5::DOUBLE - 2)) END)"
    sums = [f"coalesce(list_sum(list_transform(t{i}, lambda p: list_sum(list_transform(t{j}, lambda q: CASE WHEN p = q THEN 0 ELSE ln(1 - {weight}) END)))), 0)" for i, j in pairs]
    return f"round(1 - exp({' + '.join(sums)}), 8)"


def _found(terms: list[str], rank: str, where: str) -> str:
    lists = ", ".join(f"max(positions) FILTER (term = '{t}') AS t{i}" for i, t in enumerate(terms))
    return f"WITH {_WORDS}, held AS (SELECT doc_id, {lists} FROM postings WHERE term IN ({_listed(terms)}) GROUP BY doc_id) SELECT doc_id, {rank} AS rank FROM held WHERE {where}"


def index(spark, sf_dir):
    return K.listed_postings(table(spark, sf_dir, "documents"))


def stored(spark, sf_dir) -> str:
    """The folder of the stored postings of all documents."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    K.write_postings(index(spark, sf_dir), path)
    return path


def search(spark, sf_dir, text: str):
    parsed = K.parse(spark, text)
    return K.matches(K.stored_postings(spark, stored(spark, sf_dir), K.query_terms(parsed)), parsed)


@query(f"WITH {_WORDS} SELECT word, stem FROM stems")
def search_stems(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(E.WORD), 0)).alias("word")).distinct()
    return E.with_stems(words.filter(~E.is_stop_word(F.col("word"))), "word")


@query(f"WITH {_WORDS} SELECT term, count(*) AS texts, CAST(sum(len(positions)) AS BIGINT) AS occurrences, CAST(sum(list_sum(positions)) AS BIGINT) AS places FROM postings GROUP BY term")
def search_postings(spark, sf_dir):
    places = F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + x)
    return index(spark, sf_dir).groupBy("term").agg(F.sum(F.size("keys")).alias("texts"), F.sum(F.size("places")).alias("occurrences"), F.sum(places).alias("places"))


@query(_found(["er", "re", "tion"], _all(["er", "re", "tion"]), "len(list_filter(t0, lambda p: list_contains(t1, p + 2))) > 0 AND t2 IS NOT NULL"))
def web_search_phrase(spark, sf_dir):
    return search(spark, sf_dir, '"ers of re" tions')


@query(_found(["ed", "er", "tion"], _all(["ed", "er", "tion"]), "t0 IS NULL AND t1 IS NOT NULL AND t2 IS NOT NULL"))
def web_search_exclusion(spark, sf_dir):
    return search(spark, sf_dir, "er -ed tion")


@query(_found(["ertion", "nd", "thing"], _any(["ertion", "nd", "thing"]), "t0 IS NOT NULL OR len(list_filter(t1, lambda p: list_contains(t2, p + 1))) > 0 OR (t2 IS NOT NULL AND t1 IS NULL)"))
def web_search_or(spark, sf_dir):
    return search(spark, sf_dir, 'ertions OR "nd things" OR thing -nd')


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY rank DESC, doc_id) AS INT) AS place FROM ({_found(['ed', 'ing', 'tion'], _all(['ed', 'ing', 'tion']), 't0 IS NOT NULL AND t1 IS NOT NULL AND t2 IS NOT NULL')}) ORDER BY rank DESC, doc_id LIMIT 50")
def web_search_topk(spark, sf_dir):
    from pyspark.sql import Window

    parsed = K.parse(spark, "ing tions of the ed")
    found = K.keyword_topk(K.stored_postings(spark, stored(spark, sf_dir), K.query_terms(parsed)), parsed, 50)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "doc_id")))
