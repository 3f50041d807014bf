"""The queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from tessera.llm import bpe, chat, decontaminate, exact_dedup, katz, license_scan, merkle, quality, ranked, sharding, simhash, token_file, toxicity


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_simhash": simhash.op3_simhash,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_token_file": token_file.op5_token_file,
        "op6_quality": quality.op6_quality,
        "op7_bpe": bpe.op7_bpe,
        "op8_katz": katz.op8_katz,
        "op9_sharding": sharding.op9_sharding,
        "op10_chat": chat.op10_chat,
        "op11_ranked": ranked.op11_ranked,
        "op12_merkle": merkle.op12_merkle,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_sharding": sharding.ORACLE_SQL,
        "op10_chat": chat.ORACLE_SQL,
        "op11_ranked": ranked.ORACLE_SQL,
        "op12_merkle": merkle.ORACLE_SQL,
    }
