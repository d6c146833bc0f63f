"""P: near-duplicate detection over whole texts."""

from pyspark.sql import functions as F

from prefmine.core import stored
from prefmine.datasets import table
from prefmine.operators import dedup as N
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query

_SIG = """
WITH RECURSIVE t AS (SELECT doc_id, source, trim(regexp_replace(lower(trim(lang || ' ' || text)), '\\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, md5(unnest(string_split(t, ' '))) AS m FROM t WHERE length(t) >= 20),
h AS (SELECT doc_id, CAST('0x' || substr(m,15,2) || substr(m,13,2) || substr(m,11,2) || substr(m,9,2) || substr(m,7,2) || substr(m,5,2) || substr(m,3,2) || substr(m,1,2) AS UBIGINT) AS h FROM w),
b AS (SELECT doc_id, b, 2 * sum((h >> b) & 1) > count(*) AS up FROM h, range(64) r(b) GROUP BY 1, 2),
s AS (SELECT doc_id, CAST(sum(CASE WHEN up THEN 1::HUGEINT << b ELSE 0 END) AS UBIGINT) AS sig FROM b GROUP BY 1),
sg AS (SELECT doc_id, source, COALESCE(sig, 0) AS sig FROM t LEFT JOIN s USING (doc_id)),
o AS (SELECT *, lag(sig) OVER (PARTITION BY source ORDER BY sig, doc_id) AS prev FROM sg WHERE sig <> 0),
dup AS (SELECT source, doc_id FROM o WHERE prev IS NOT NULL AND bit_count(CAST(xor(sig, prev) AS HUGEINT)) <= 3)
"""


def signed(spark, d):
    docs = table(spark, d, "documents")
    text = F.trim(F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source").join(N.simhash(docs, "doc_id", text), "doc_id")


def signatures(spark, d):
    return stored(signed(spark, d), "signed")


@query("p01_simhash", _SIG + "SELECT doc_id, format('{:016X}', sig) AS signature FROM sg", "")
def simhash(spark, d):
    return signed(spark, d).select("doc_id", F.lpad(F.hex("signature"), 16, "0").alias("signature"))


@query("p02_near_duplicates", _SIG + "SELECT source, doc_id FROM dup", "")
def near_duplicates(spark, d):
    return N.near_duplicates(signatures(spark, d), "source", "doc_id")


@query("p02_near_duplicates_strict", _SIG + """, o2 AS (SELECT *, lag(sig) OVER (PARTITION BY source ORDER BY sig, doc_id) AS prev FROM sg)
SELECT source, doc_id FROM o2 WHERE prev IS NOT NULL AND bit_count(CAST(xor(sig, prev) AS HUGEINT)) <= 3""", "")
def near_duplicates_strict(spark, d):
    return N.near_duplicates(signatures(spark, d), "source", "doc_id", strict=True)


@query("p03_duplicate_rates", _SIG + """
SELECT source, count(*) AS n, (SELECT count(*) FROM dup x WHERE x.source = sg.source) AS dups,
       ROUND((SELECT count(*) FROM dup x WHERE x.source = sg.source) * 100.0 / count(*), 6) AS rate FROM sg GROUP BY source
""", "")
def duplicate_rates(spark, d):
    rows = signatures(spark, d)
    return rounded(N.duplicate_rates(rows, N.near_duplicates(rows, "source", "doc_id"), "source"), "rate")


@query("p04_clean_output", _SIG + "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dup)", "")
def clean_output(spark, d):
    dups = N.near_duplicates(signatures(spark, d), "source", "doc_id")
    return N.without_duplicates(table(spark, d, "documents"), dups, "doc_id", ["doc_id", "lang", "source", "n_chars"])


@query("p05_band_classes", _SIG + """, n AS (SELECT sig, min(doc_id) AS f, count(*) AS c FROM sg WHERE sig <> 0 GROUP BY sig),
q AS (SELECT sig, b, (sig >> (16 * b)) & 65535 AS v FROM n, range(4) r(b)),
l AS (SELECT DISTINCT x.sig AS x, y.sig AS y FROM q x JOIN q y ON x.b = y.b AND x.v = y.v AND x.sig <> y.sig WHERE bit_count(CAST(xor(x.sig, y.sig) AS HUGEINT)) <= 3),
k AS (SELECT x AS sig, sum(c) AS near FROM l JOIN n ON n.sig = l.y GROUP BY 1),
z AS (SELECT sig, f AS root FROM n UNION SELECT l.y, z.root FROM z JOIN l ON l.x = z.sig JOIN n ON n.sig = l.y WHERE z.root < n.f),
m AS (SELECT sig, min(root) AS root FROM z GROUP BY 1)
SELECT doc_id, root AS class_id, CAST(c - 1 + COALESCE(near, 0) AS BIGINT) AS n_links FROM sg JOIN n USING (sig) JOIN m USING (sig) LEFT JOIN k USING (sig)""", "")
def band_classes(spark, d):
    return N.band_classes(signatures(spark, d), "doc_id")
