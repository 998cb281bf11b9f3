"""Queries of the training-data operators, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, canonical, language, mixing, neighbors, ranking, repetition, scans, sentences, split


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": ranking.p1_found,
        "p2_found": sentences.p2_found,
        "p3_found": neighbors.p3_found,
        "p3_knn": neighbors.p3_knn,
        "p3_nearest": neighbors.p3_nearest,
        "p4_found": canonical.p4_found,
        "p4_classes": canonical.p4_classes,
        "p5_found": scans.p5_found,
        "p5_paragraphs": scans.p5_paragraphs,
        "p6_found": language.p6_found,
        "p6_languages": language.p6_languages,
        "p6_segments": language.p6_segments,
        "p7_found": split.p7_found,
        "p7_pieces": split.p7_pieces,
        "p8_ids": bpe.p8_ids,
        "p9_found": mixing.p9_found,
        "p9_mix": mixing.p9_mix,
        "p9_shares": mixing.p9_shares,
        "p10_found": repetition.p10_found,
        "p10_shares": repetition.p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": ranking.ORACLE,
        "p3_found": neighbors.ORACLE_FOUND,
        "p3_knn": neighbors.ORACLE_KNN,
        "p3_nearest": neighbors.ORACLE_NEAREST,
        "p4_found": canonical.oracle_found(),
        "p4_classes": canonical.oracle_classes(),
        "p7_found": split.ORACLE,
    }
