"""Counts, filters, sources and exports of the shortlist cover every role, not a page of them."""

import pytest

from __spark_entry__ import queries
from postgrain.operators import shortlist as H
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.catalog.tracking import LISTED
from tests.compare import connect

FOLDER = "/root/testdata/sf0.01"


def test_every_role_is_counted_filtered_and_exported(spark):
    every = connect(FOLDER).execute(S.with_(S.POSTINGS, S.SCORES, S.EVENTS, LISTED) + f"""
SELECT r.job_id, source, {S.progress('a.status', 0)} AS stage,
  contains(lower(company), 'engineer') OR contains(lower(title), 'engineer') AS fits
FROM ranked r LEFT JOIN applications a ON a.job_id = r.job_id WHERE place = 1""").fetchall()
    assert len(every) > 500
    run = {name: queries()[name](spark, FOLDER).collect() for name in (
        "stage_counts", "filtered_shortlist", "shortlist_sources", "export_rows", "health_report")}
    stages = [stage for _, _, stage, _ in every]
    assert {r.stage: r.entries for r in run["stage_counts"]} == {s: stages.count(s) for s in stages}
    assert sorted(r.job_id for r in run["filtered_shortlist"]) == sorted(
        i for i, _, stage, fits in every if fits and stage == "waiting")
    assert {r.source for r in run["shortlist_sources"]} == {source for _, source, *_ in every}
    assert sorted(int(r.job_id) for r in run["export_rows"]) == sorted(i for i, *_ in every)
    scores = [float(r.score) for r in run["export_rows"]]
    assert scores == sorted(scores, reverse=True)
    counted = int(next(r.detail for r in run["health_report"] if r.label == "shortlist").split()[0])
    assert counted == len(every)


def test_a_page_above_the_cap_is_refused(spark):
    postings, scores = B.postings(spark, FOLDER), B.scores(spark, FOLDER)
    with pytest.raises(ValueError, match="501"):
        H.shortlist(postings, scores, None, "rubric-v1", "p1", limit=501)
