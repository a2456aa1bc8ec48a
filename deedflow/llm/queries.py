"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each query reads its whole tables, calls one operator with its production parameters and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedflow.llm.common import table
from deedflow.llm.decontaminate import SLACK, decontaminate
from deedflow.llm.exact_dedup import exact_dedup
from deedflow.llm.line_dedup import LEAST, RATIO, line_dedup
from deedflow.llm.mixing import mix, taken
from deedflow.llm.pii import find_personal
from deedflow.llm.quality import learn, score
from deedflow.llm.secret_scan import find_secrets, ranked_words
from deedflow.llm.simhash import simhash_groups
from deedflow.llm.substring_dedup import substring_dedup
from deedflow.llm.token_counts import token_counts

#: The vocabulary that op10 counts with and op3 takes its ranked words from, by its name in the public collection.
VOCABULARY = "piece_bpe_32k.model"


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents),
g AS (SELECT sha, count(*) AS c, min((-n, doc_id)) AS f FROM d GROUP BY sha)
SELECT d.doc_id, g.f[2] AS keep_id, g.c::BIGINT AS group_size, d.doc_id = g.f[2] AS kept, d.sha AS text_sha256
FROM d JOIN g USING (sha)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(table(spark, sf_dir, "documents"), words=ranked_words(public_tokenizers.path(VOCABULARY)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), host="source")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
held AS (SELECT source, line, count(*) AS c FROM (SELECT source, unnest(list_distinct([x FOR x IN ls IF regexp_matches(x, '[^\x20\x09-\x0D]')])) AS line FROM d) GROUP BY ALL),
total AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bad AS (SELECT h.source, list(line) AS lines FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source WHERE c >= {LEAST} AND c > n * {RATIO}::DOUBLE GROUP BY h.source),
k AS (SELECT doc_id, ls, [x FOR x IN ls IF NOT list_contains(coalesce(lines, []), x)] AS kept FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=SLACK)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"[x FOR x IN regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
places AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
cnt AS (SELECT term, count(*) AS c FROM pos GROUP BY term),
it AS (SELECT *, row_number() OVER () AS key FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
terms AS (SELECT key, s, p, w[p + 1] AS term FROM (SELECT key, w, s, unnest(range(s, s + least(len(w), 10))) AS p FROM (SELECT key, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM it))),
ranked AS (SELECT t.*, min(coalesce(c, 0)) OVER (PARTITION BY key, s) AS least, row_number() OVER (PARTITION BY key, s ORDER BY coalesce(c, 0), p) AS k FROM terms t LEFT JOIN cnt USING (term)),
rare AS (SELECT * FROM ranked WHERE least > 0 AND k <= 2),
met AS (SELECT doc_id, key, s, p, pos - p AS shift FROM pos JOIN rare USING (term)),
heads AS (SELECT key, s, min(p) AS p, count(*) AS need FROM rare GROUP BY ALL),
firsts AS (SELECT m.*, need FROM met m JOIN heads USING (key, s, p)),
near AS (SELECT f.doc_id, f.key FROM firsts f JOIN met m ON f.doc_id = m.doc_id AND f.key = m.key AND f.s = m.s AND abs(m.shift - f.shift) <= 3 GROUP BY f.doc_id, f.key, f.s, f.shift, f.need HAVING count(DISTINCT m.p) = f.need),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS c FROM near JOIN it USING (key) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.c, 0)::BIGINT AS n_hit, coalesce(i.c, 0)::BIGINT AS n_items, sha256(coalesce(i.l, '')) AS items_sha256, coalesce(p.c, 0) > 0 AS contaminated, coalesce(n.c, 0)::BIGINT AS n_near
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN nears n USING (doc_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
least_id AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN least_id USING (k) WHERE f < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_personal_data, op2_exact_dedup, op3_secrets, op4_line_dedup, op5_quality, op6_mixing, op7_decontaminate, op8_simhash, op9_substring_dedup, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_decontaminate": OP7_SQL, "op9_substring_dedup": OP9_SQL}
