"""Registered queries of this subpackage and the SQL that checks them, where SQL can express them."""

from .decontaminate import op1_decontamination
from .jaccard import op3_jaccard_join
from .language import op9_language_id
from .neighbours import op2_nearest_neighbours
from .packing import op6_best_fit_packing
from .quality import op5_quality_ranking
from .secrets import op10_secret_scans
from .substring import op8_substring_dedup
from .toxicity import op7_toxicity
from .urlrules import OP4_SQL, op4_url_rules

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_rules": op4_url_rules,
    "op5_quality_ranking": op5_quality_ranking,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_secret_scans": op10_secret_scans,
}

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS node, x AS root FROM both_ways UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later FROM win),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT w.doc_id, w.i, w.word, coalesce(bool_or(l.later) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op4_url_rules": OP4_SQL,
    "op8_substring_dedup": OP8_SQL,
}
