"""Reference sets, standing configuration, tree surveys, support and address classes on planted cases."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from casewright import functions as X
from casewright.operators import answers as A
from casewright.operators import persistence as P
from casewright.operators import references as R
from casewright.operators import survey as S
from casewright.sources.scratch import keep

DAY = dt.date
REFS = "family string, variant string, kind string, value string, sources int, dated_from date, dated_to date, fresh_until date"


def families(spark, seen):
    early, late, fresh, past = DAY(2023, 5, 1), DAY(2025, 9, 1), DAY(2027, 5, 3), DAY(2026, 1, 1)
    refs = [
        ("ash", "a1", "extension", ".ash", 2, early, late, fresh), ("ash", "a1", "note", "ash_note.txt", 1, early, late, fresh), ("ash", "a2", "note", "ashnew.txt", 1, early, late, fresh),
        ("oak", None, "extension", ".OAK", 2, early, late, past), ("oak", None, "note", "readme.txt", 1, None, None, past), ("elm", None, "note", "ReadMe.txt", 1, None, None, fresh), ("elm", None, "note", "elm.txt", 1, None, None, None),
    ]
    obs = spark.createDataFrame(seen, "key int, kind string, value string, seen date")
    kinds = ["extension", "note"]
    found = R.family_candidates(obs, spark.createDataFrame(refs, REFS), kinds, F.lit(DAY(2026, 12, 1)))
    return {r["key"]: r for r in R.family_match(obs.select("key"), found, kinds).collect()}, {(r["key"], r.family): r for r in found.collect()}


def test_families(spark):
    seen = [
        (1, "extension", ".ASH", DAY(2024, 1, 1)), (1, "note", "ash_note.txt", None), (1, "note", "ash_note.txt", None), (2, "note", "README.TXT", None), (3, "extension", ".docx", None), (4, "extension", ".ash", DAY(2020, 1, 1)), (4, "note", "ASHNEW.txt", None),
        (5, "extension", ".ash", DAY(2026, 1, 1)), (5, "note", "elm.txt", None), (6, None, ".ash", None), (6, "note", None, None), (7, "extension", ".ash", None), (7, "extension", ".oak", None), (8, "extension", ".oak", None),
    ]
    got, by = families(spark, seen)
    assert {k: (r.outcome, r.leading, r.contradiction, r.status) for k, r in got.items()} == {
        1: ("candidate", "ash", False, "complete"), 2: ("ambiguous", None, False, "partial"), 3: ("unidentified", None, False, "complete"), 4: ("candidate", "ash", True, "complete"),
        5: ("leading_candidate", "ash", True, "complete"), 6: ("unidentified", None, False, "complete"), 7: ("ambiguous", None, False, "partial"), 8: ("candidate", "oak", False, "partial"),
    }
    assert by[1, "ash"].support == "corroborated" and by[8, "oak"].support == "single_feature" and by[2, "elm"].support == "weak_lead"
    assert [by[k].period for k in ((1, "ash"), (4, "ash"), (5, "ash"), (5, "elm"))] == ["within_cited_sources", "before_cited_sources", "after_cited_sources", "not_stated"]
    assert by[4, "ash"].variants_differ and not by[1, "ash"].variants_differ
    assert families(spark, []) == ({}, {})


def test_lookup(spark):
    make = spark.createDataFrame
    asked = make([(1, "Black  Ash", None), (2, "BASH", "v2"), (3, "elm", "v1"), (4, "nobody", "v1"), (5, None, None), (6, "black-ash", "V1"), (7, "black ash", None)], "key int, name string, variant string")
    entries = make([(1, "black-ash", DAY(2026, 1, 1)), (2, "Elm", None)], "entry int, name string, fresh_until date")
    aliases = make([(1, "Bash"), (2, "..."), (1, "black_ash")], "entry int, name string")
    variants, needs = make([(1, "v1"), (1, "v1")], "entry int, variant string"), make([(1, "pair"), (1, "memory"), (1, "pair")], "entry int, need string")
    held = make([(1, "pair", True), (1, "memory", True), (2, "pair", False), (6, "pair", True), (7, "pair", True), (7, "pair", False), (7, "memory", True)], "key int, need string, held boolean")
    got = {r["key"]: r for r in R.lookup(asked, entries, aliases, variants, needs, held, F.lit(DAY(2026, 6, 1))).collect()}
    assert {k: r.entry for k, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: None, 5: None, 6: 1, 7: 1}
    assert {k: r.prerequisites for k, r in got.items()} == {1: "all_met", 2: "not_met", 3: "none_stated", 4: None, 5: None, 6: "unknown", 7: "unknown"}
    assert {k: r.variant_status for k, r in got.items() if k < 4 or k > 5} == {1: "variant_not_given", 2: "not_stated_for_this_variant", 3: "source_names_no_versions", 6: "stated_for_this_variant", 7: "variant_not_given"}
    assert got[1].stale and not got[3].stale and got[4].result == "no_entry_in_snapshot" and got[4].stale is None


def test_persistence(spark):
    make = spark.createDataFrame
    lines = [("foo", "ExecStart", "/opt/app", 0, 1), ("foo", "User", "root", 0, 2), ("foo", "ExecStart", "", 1, 1), ("foo", "ExecStart", "/bin/true", 1, 2), ("foo", "User", "nobody", 2, 1), ("bar", "ExecStart", "/bin/x", 0, 1), ("bar", "ExecStart", None, 9, 1), ("two", "ExecStart", "a", 0, 1), ("two", "ExecStart", "b", 1, 1), ("off", "ExecStart", "c", 0, 1)]
    df = make(lines, "unit string, key string, value string, dropin int, line int")
    stand = {(r.unit, r["key"], r.value) for r in P.standing_assignments(df, ["dropin", "line"], ["ExecStart"]).collect()}
    assert stand == {("foo", "ExecStart", "/bin/true"), ("foo", "User", "nobody"), ("two", "ExecStart", "a"), ("two", "ExecStart", "b"), ("off", "ExecStart", "c")}
    links = make([("off", "/dev/null"), ("al", "foo"), ("al2", "al"), ("al2", "al"), ("gone", "/dev/null"), ("hid", "off"), ("x", "y"), ("y", "x"), ("d", "foo"), ("d", "two"), ("e", "d")], "name string, target string")
    ends = {r.name: (r.unit, r.masked, r.state) for r in P.resolve_links(links, keep).collect()}
    assert ends == {"off": (None, True, "masked"), "al": ("foo", False, "alias"), "al2": ("foo", False, "alias"), "gone": (None, True, "masked"), "hid": (None, True, "masked"), "x": (None, False, "cyclic"), "y": (None, False, "cyclic"), "d": (None, False, "contested"), "e": (None, False, "contested")}
    names = lambda *n: make([(x,) for x in n], "name string")
    got = {r.unit: r for r in P.persistence(df, ["dropin", "line"], links, names("al2", "off"), names("al", "foo", "ghost", "off"), keep).collect()}
    assert {u: (r.configuration, r.execution, r.commands, r.runs) for u, r in got.items()} == {
        "foo": ("enabled", "seen", 1, 2), "bar": ("no_command", "not_seen", 0, 0), "two": ("dormant", "not_seen", 2, 0), "off": ("masked", "seen", 1, 1), "gone": ("masked", "not_seen", 0, 0), "hid": ("masked", "not_seen", 0, 0), "ghost": ("none", "seen", 0, 1),
    }
    assert got["foo"].aliases == 2 and got["foo"].resets == 1
    assert P.persistence(df.limit(0), ["dropin", "line"], links.limit(0), names(), names(), keep).count() == 0


def test_survey(spark):
    rng = random.Random(5)
    noise, plain = rng.randbytes(100_000), (b"The figures were approved without change. " * 4000)[:100_000]
    files = [("a/photos.zip", noise, True), ("a/report.doc.locked", noise, True), ("a/notes.txt", plain, True), ("a/tiny.txt", plain[:4096], True), ("a/tiny.doc.ID7.locked", b"", True), ("b.docx/x.locked", plain, True), ("a/gone.db.crypt", None, False), ("a/unread", noise, None), ("a/mixed.bin", plain[: 64 << 10] + noise, True), (".profile", plain, True), ("a/end.doc.", plain, True)]
    df = spark.createDataFrame([(p, b, len(b or b""), r, "head") for p, b, r in files], "path string, raw binary, size long, ok boolean, reasons_of string")
    out = S.tree_survey(df, "path", "size", "raw", "ok")
    got = {r.path: r for r in out.collect()}
    assert {p: r.status for p, r in got.items()} == {"a/photos.zip": "candidate", "a/report.doc.locked": "candidate", "a/notes.txt": "noncandidate", "a/tiny.txt": "unmeasured", "a/tiny.doc.ID7.locked": "candidate", "b.docx/x.locked": "noncandidate", "a/gone.db.crypt": "read_failed", "a/unread": "read_failed", "a/mixed.bin": "noncandidate", ".profile": "noncandidate", "a/end.doc.": "noncandidate"}
    assert got["a/report.doc.locked"].reasons == "appended_extension_after_known_extension,head_entropy_at_least_7.5" and got["a/report.doc.locked"].appended == ".locked"
    head = plain[: 64 << 10]
    want = -sum(head.count(bytes([c])) / len(head) * math.log2(head.count(bytes([c])) / len(head)) for c in set(head))
    assert abs(got["a/mixed.bin"].head_entropy - want) < 1e-9 and got["a/tiny.txt"].head_entropy is None
    total = S.survey_totals(out, [], "size").first()
    assert (total.visited, total.candidate, total.read_failed, total.fraction, total.state) == (11, 3, 2, 0.2727, "partial")
    assert S.tree_survey(df.limit(0), "path", "size", "raw", "ok").count() == 0


def test_support(spark):
    make = spark.createDataFrame
    entries = make([(1, "entry", False), (2, "entry", True), (3, "answer", False), (4, "answer", None), (5, "answer", True), (6, "entry", None), (1, "entry", False)], "seq int, kind string, superseded boolean")
    cites = make([(3, 1), (3, 2), (3, 9), (3, 1), (5, 9)], "seq int, cited int")
    tokens = make([(1, "x1"), (3, "x1"), (3, "y2"), (3, "y2"), (4, "z3"), (5, "q"), (2, None)], "seq int, token string")
    disputes = make([(1, True), (2, True), (4, False)], "target int, stands boolean")
    rests = make([(6, 70, True, None), (6, 70, True, None), (1, 71, True, True), (2, 72, True, False), (6, 73, False, False)], "seq int, job int, failed boolean, qualified boolean")
    got = {(r.seq, r.code): r.n for r in A.support_defects(entries, cites, tokens, disputes, rests).collect()}
    assert got == {(1, "disputed"): 1, (3, "missing"): 1, (3, "replaced"): 1, (3, "rests_on_disputed"): 2, (3, "unsupported_tokens"): 1, (4, "no_support"): 1, (4, "unsupported_tokens"): 1, (6, "failed_job"): 1}


def test_quick_negatives(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    leads = spark.createDataFrame([(1, 7, at(0), at(2), True), (2, 7, at(10), at(11), False), (3, 7, at(20), at(25), True), (4, 7, at(30), None, True), (5, 7, at(40), at(41), True), (6, 7, at(50), at(51), True)], "lead int, seat int, f timestamp, t timestamp, negative boolean")
    jobs = spark.createDataFrame([(91, 7, at(2), "a"), (92, 7, at(10), "a"), (93, 7, at(21), "a"), (94, 7, at(40), "a"), (94, 7, at(40), "b"), (95, 8, at(50), "a"), (96, 7, at(3), "z")], "job int, seat int, at timestamp, object string")
    got = [tuple(r) for r in A.quick_negatives(leads, jobs, "seat", "f", "t", "at").collect()]
    assert got == [(1, 120_000_000, 91, "a")]


def test_addresses(spark):
    want = {
        "10.0.0.1": "private", "172.15.0.1": "public", "172.16.0.1": "private", "172.31.255.255": "private", "172.32.0.1": "public", "192.168.1.1": "private", "100.64.0.1": "shared", "100.128.0.1": "public", "127.0.0.1": "loopback", "169.254.1.1": "link_local", "8.8.8.8": "public",
        "224.0.0.1": "multicast", "255.255.255.255": "reserved", "0.0.0.0": "reserved", "203.0.113.9": "documentation", "256.1.1.1": "invalid", "1.2.3": "invalid", "": "invalid", "10.0.0.1 ": "private", "::1": "loopback", "FE80::1%eth0": "link_local", "fd00::1": "private", "ff02::1": "multicast",
        "2001:db8::1": "documentation", "2a00::1": "public", "::ffff:192.168.0.1": "private", "host": "invalid",
    }
    rows = spark.createDataFrame([(a,) for a in [*want, None]], "a string").select("a", X.address_class(F.col("a")).alias("c"), X.traffic_side(F.col("a"), F.lit("8.8.8.8")).alias("s")).collect()
    assert {r.a: r.c for r in rows} == {**want, None: None}
    side = {r.a: r.s for r in rows}
    assert (side["10.0.0.1"], side["8.8.8.8"], side["host"], side[None]) == ("outbound", "external", "unknown", "unknown")
