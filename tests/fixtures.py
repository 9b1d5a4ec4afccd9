"""Tiny hand-written tables. Page ids exceed 2^53, as real ones do."""

from __future__ import annotations

import datetime as dt

from reachlens.sources import schemas

A, B, C = 17841400000000001, 17841400000000003, 17841400000000005
D, T = dt.date, dt.datetime
AS_OF = "2024-03-15"
YESTERDAY = D(2024, 3, 14)


def post(page, post_id, created, reach=100, likes=10, comments=1, caption="caption", load=YESTERDAY, saved=0, shares=0,
         media="VIDEO", source="u"):
    return (page, post_id, load, created, caption, reach, likes, comments, saved, shares, media, source)


def posts(spark, rows):
    return spark.createDataFrame(rows, schemas.POSTS)


def account(spark, rows):
    return spark.createDataFrame(rows, schemas.ACCOUNT_DAILY)


def analysis(spark, rows):
    """Rows as dicts; columns left out are null."""
    names = schemas.POST_ANALYSIS.names
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schemas.POST_ANALYSIS)


def ideas(spark, rows):
    names = schemas.POST_IDEAS.names
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schemas.POST_IDEAS)


def by_key(frame, key):
    return {row[key]: row for row in frame.collect()}
