"""What the driver's entry adds when this subpackage is there."""

from __future__ import annotations

from spindrift.llm import queries as q


def queries() -> dict:
    return {
        "op1_exact_dedup": q.op1_exact_dedup,
        "op2_warc": q.op2_warc,
        "op3_pii": q.op3_pii,
        "op4_simhash": q.op4_simhash,
        "op5_decontaminate": q.op5_decontaminate,
        "op6_toxicity": q.op6_toxicity,
        "op7_mixing": q.op7_mixing,
        "op8_tokens": q.op8_tokens,
        "op9_chat": q.op9_chat,
        "op10_html": q.op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": q.OP1_SQL, "op7_mixing": q.OP7_SQL, "op9_chat": q.OP9_SQL}
