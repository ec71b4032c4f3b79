"""Verdicts of many profiles: the table of rules gives what inlined profiles give."""

import random

import pytest

from postgrain.operators import filters
from postgrain.operators.profiles import Profile, load_profiles
from postgrain.rules.constants import SENIORITY_LEVELS, TITLE_FAMILIES

PLACES = ["Lyon", "New York", "London", "Remote - EMEA", "Berlin, Germany", "United Kingdom", "São Paulo", "York", "Europe"]
LOCATIONS = [None, "", "Lyon", "Remote", "Remote - US", "New York, NY", "Remote (Europe)", "London, UK / Berlin, Germany", "York",
             "Remote, Canada", "Berlin", "EMEA", "remote in United Kingdom or Lyon", "Austin, TX", "Tokyo / Remote", "New  York-Lyon", "123"]
POSTING = ("id int, status string, description string, description_hash string, title_family string, seniority string, "
           "remote boolean, location string")


def rows():
    draw = random.Random(3)
    return [(k, draw.choice(["active"] * 4 + ["expired"]), draw.choice(["", "Must be eligible to work in the UK.", "Fine."]), f"h{k}",
             draw.choice([None, *TITLE_FAMILIES]), draw.choice([None, *SENIORITY_LEVELS]), draw.choice([True, False, None]),
             draw.choice(LOCATIONS)) for k in range(160)]


def profiles(count):
    draw = random.Random(4)
    out = []
    for k in range(count):
        low, high = sorted(draw.choices(range(len(SENIORITY_LEVELS)), k=2))
        out.append(Profile(
            f"p{k}", draw.random() < 0.3, tuple(draw.sample(PLACES, draw.randrange(4))),
            tuple(draw.sample(list(TITLE_FAMILIES), draw.randint(1, 3))), SENIORITY_LEVELS[low], SENIORITY_LEVELS[high]))
    return out


def found(frame):
    return sorted((r.job_id, r.profile_version, r.description_hash, tuple(r.reasons), r.hard_filter_pass) for r in frame.collect())


@pytest.mark.parametrize("block", [200, 7])
def test_table_gives_what_inlined_profiles_give(spark, monkeypatch, block):
    postings = spark.createDataFrame(rows(), POSTING)
    chosen = profiles(40)
    want = found(filters.hard_filter_verdicts(postings, chosen))
    assert len(want) > 4000 and len({w[3] for w in want}) > 50
    monkeypatch.setattr(filters, "PROFILE_LIMIT", block)
    table = filters.profile_rules(spark, chosen)
    assert found(filters.verdicts_by_table(postings, table)) == want


def test_more_profiles_than_are_inlined(spark):
    postings = spark.createDataFrame(rows(), POSTING)
    chosen = profiles(700)
    verdicts = filters.hard_filter_verdicts(postings, chosen)
    active = sum(r[1] == "active" for r in rows())
    assert verdicts.count() == 700 * active
    some = [p for p in chosen if p.version in ("p3", "p450", "p699")]
    assert found(verdicts.where("profile_version in ('p3', 'p450', 'p699')")) == found(filters.hard_filter_verdicts(postings, some))
    plans = [filters.hard_filter_verdicts(postings, chosen[:n])._jdf.queryExecution().optimizedPlan().toString() for n in (300, 700)]
    assert abs(len(plans[0]) - len(plans[1])) < 200


def test_all_profiles_are_loaded(spark):
    table = spark.createDataFrame([(f"p{k}", ["Lyon"]) for k in range(450)], "version string, accepted_locations array<string>")
    assert len(load_profiles(table)) == 450
