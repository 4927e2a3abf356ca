"""The operators' queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, fingerprint, langid, languagemodel, mixing, pii, quality, sharding, simhash, urls


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1,
        "op2_languagemodel": languagemodel.op2,
        "op3_langid": langid.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_fingerprint": fingerprint.op5,
        "op6_quality": quality.op6,
        "op7_simhash": simhash.op7,
        "op8_pii": pii.op8,
        "op9_urls": urls.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_urls": urls.duckdb_sql()}
