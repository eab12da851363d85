"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, langid, pii, quality, simhash, suffix, warc, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.query,
    "op2_langid": langid.query,
    "op3_warc": warc.query,
    "op4_pii": pii.query,
    "op5_suffix": suffix.query,
    "op6_chat": chat.query,
    "op7_wrapper": wrapper.query,
    "op8_simhash": simhash.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op6_chat": chat.SQL,
}
