"""Queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from quern.llm.decontaminate import OP5_SQL, op5_decontaminate
from quern.llm.embeddings import OP7_SQL, op7_embeddings
from quern.llm.katz import op3_katz
from quern.llm.lines import op9_lines
from quern.llm.mixing import OP6_SQL, op6_mixing
from quern.llm.quality import op2_quality
from quern.llm.repeats import OP8_SQL, op8_repeats
from quern.llm.secrets import op4_secrets
from quern.llm.simhash import op1_simhash
from quern.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_katz, op4_secrets, op5_decontaminate, op6_mixing, op7_embeddings, op8_repeats, op9_lines, op10_toxicity)}
ORACLES: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op6_mixing": OP6_SQL, "op7_embeddings": OP7_SQL, "op8_repeats": OP8_SQL}
