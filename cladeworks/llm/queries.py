"""The corpus operators as queries over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from . import common as c, decontaminate, langid, line_dedup, lm_score, mixing, mpeg, near_join, quality_fm, secrets_crf, warc


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op2_near_join(spark, sf_dir):
    return near_join.join(c.table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_lm_score(spark, sf_dir):
    return lm_score.cross_entropy_difference(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(c.table(spark, sf_dir, "pages"))


def op5_langid(spark, sf_dir):
    return langid.identify(c.table(spark, sf_dir, "pages"), c.table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets_crf.secrets(c.table(spark, sf_dir, "documents"))


def op7_quality_fm(spark, sf_dir):
    return quality_fm.predictions(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op8_mpeg_audio(spark, sf_dir):
    return mpeg.digest(c.table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.digest(c.table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.placed(c.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_join": op2_near_join,
    "op3_lm_score": op3_lm_score,
    "op4_warc": op4_warc,
    "op5_langid": op5_langid,
    "op6_secrets": op6_secrets,
    "op7_quality_fm": op7_quality_fm,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}
ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_near_join": near_join.SQL,
    "op4_warc": warc.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
