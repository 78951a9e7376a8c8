"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .langid import op6_cross_parsing
from .linededup import op4_log_templates
from .media import op3_lossless_webp
from .mixing import op7_min_cost_flow
from .neardup import op9_containment_ensemble
from .packing import op1_best_fit
from .quality import op2_cotraining
from .sharding import op10_histogram_sort
from .topk import op5_bit_sliced_index
from .toxicity import op8_weak_supervision


def queries():
    return {f.__name__: f for f in (op1_best_fit, op2_cotraining, op3_lossless_webp, op4_log_templates, op5_bit_sliced_index, op6_cross_parsing, op7_min_cost_flow, op8_weak_supervision, op9_containment_ensemble, op10_histogram_sort)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_bit_sliced_index": """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    }
