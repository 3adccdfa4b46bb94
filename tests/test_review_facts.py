"""Kept facts of clusters against facts made anew, over rounds of changes."""

import random

from pyspark.sql import functions as F

from postmill.operators import review_facts as rf
from postmill.operators import store
from postmill.schema import TABLES

COLUMNS = "account_id string, provider_msg_id string, sender string, subject string, internal_date long, label_ids array<string>"


def said(facts):
    """Counts and first message of each group."""
    return {tuple(r[c] for c in rf.GROUP): (r["member_count"], r["unsubscribe_count"], r["first"][0].asDict()) for r in facts.collect()}


def tables(spark, mail):
    rows = [("a", k, v["sender"], v["subject"], v["at"], v["labels"]) for k, v in mail.items()]
    members = [("a", k, v["cluster"], 1.0, None) for k, v in mail.items()]
    return spark.createDataFrame(members, TABLES["message_clusters"]), spark.createDataFrame(rows, COLUMNS)


def message(rng, i):
    return {"cluster": rng.choice(["hot"] * 6 + [f"c{i % 5}", "none"]), "sender": f"s{i}", "subject": None if i % 9 == 0 else f"t{i}", "at": rng.choice([None, 5, 5, rng.randrange(1000)]), "labels": rng.choice([None, [], ["INBOX"], ["x-List-Unsubscribe"], [None]])}


def test_rounds_of_changes(spark):
    """Messages come, go, move between clusters and times; the oldest ones of all clusters go, so that some are read again."""
    rng = random.Random(8)
    mail = {f"m{i}": message(rng, i) for i in range(120)}
    facts = rf.facts_of(rf.member_rows(*tables(spark, mail)), keep=3)
    for turn in range(4):
        new = dict(mail)
        for k in rng.sample(sorted(mail), 25):
            new[k] = message(rng, rng.randrange(1000)) if rng.random() < 0.6 else None
        if turn == 1:
            new |= {k: None for k, v in mail.items() if (v["at"] or 0) < 200}
        if turn == 2:
            new |= {k: None for k, v in mail.items() if v["cluster"] == "none"}
        new |= {f"n{turn}-{i}": message(rng, i) for i in range(20)}
        new = {k: v for k, v in new.items() if v}
        moved = [(k,) for k in {*mail, *new} if mail.get(k) != new.get(k)]
        keys = spark.createDataFrame(moved, "provider_msg_id string")
        rows = [rf.member_rows(*tables(spark, t)).join(keys, "provider_msg_id", "left_semi") for t in (mail, new)]
        facts = store.settled(rf.changed(facts, rf.deltas(*rows), *tables(spark, new), keep=3), "facts")
        mail = new
        assert said(facts) == said(rf.facts_of(rf.member_rows(*tables(spark, mail)), keep=3))


def test_only_what_ran_dry_is_read_again(spark, monkeypatch):
    """Facts of other clusters, and of those with kept messages left, come without the tables."""
    rng = random.Random(3)
    mail = {f"m{i:03}": {**message(rng, i), "at": i, "cluster": f"c{i % 3}"} for i in range(60)}
    members, messages = tables(spark, mail)
    facts = rf.facts_of(rf.member_rows(members, messages), keep=2)
    read = []
    whole = rf.facts_of
    monkeypatch.setattr(rf, "facts_of", lambda rows, keep: read.append({r[0] for r in rows.select("cluster_key").collect()}) or whole(rows, keep))
    gone = rf.member_rows(members, messages.filter("provider_msg_id in ('m000', 'm001', 'm004', 'm050')"))
    left = messages.filter("provider_msg_id not in ('m000', 'm001', 'm004', 'm050')")
    got = said(rf.changed(facts, rf.deltas(gone, gone.limit(0)), members, left, keep=2))
    assert read == [{"c1"}] and got == said(whole(rf.member_rows(members, left), 2))


def test_empty(spark):
    members, messages = tables(spark, {})
    none = rf.member_rows(members, messages)
    facts = rf.facts_of(none)
    assert rf.changed(facts, rf.deltas(none, none), members, messages).count() == 0 and rf.for_queue(facts).count() == 0
    rng = random.Random(1)
    one = tables(spark, {"m": message(rng, 1)})
    got = rf.changed(facts, rf.deltas(none, rf.member_rows(*one)), *one)
    assert got.agg(F.sum("member_count")).first()[0] == 1
    assert rf.changed(got, rf.deltas(rf.member_rows(*one), none), members, messages).count() == 0
