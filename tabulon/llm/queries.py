"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .op1_embedding_dedup import OP1_SQL, op1_embedding_dedup
from .op2_line_dedup import OP2_SQL, op2_line_dedup
from .op3_quality import op3_quality
from .op4_mixing import op4_mixing
from .op5_pii import op5_pii
from .op6_packing import op6_packing
from .op7_sharding import op7_sharding
from .op8_jaccard_join import OP8_SQL, op8_jaccard_join
from .op9_warc import OP9_SQL, op9_warc
from .op10_url_filters import OP10_SQL, op10_url_filters

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_line_dedup, op3_quality, op4_mixing, op5_pii, op6_packing, op7_sharding, op8_jaccard_join, op9_warc, op10_url_filters)}
SQL = {"op1_embedding_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op9_warc": OP9_SQL, "op10_url_filters": OP10_SQL}
