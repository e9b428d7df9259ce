"""Edge cases of scalar functions and joins: nulls, ties, touching ends, odd calendars."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casewright import functions as X
from casewright.operators import aggregates as A
from casewright.operators import intervals as I
from casewright.operators import joins as J
from casewright.operators import predicates as P
from casewright.operators import sequence as S
from casewright.operators import texts as T
from casewright.operators.sweep import sweep
from casewright.sources.scratch import keep


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_dates(spark):
    word = lambda y, m, d, h, mi, s: ((y - 1980) << 25) | (m << 21) | (d << 16) | (h << 11) | (mi << 5) | s
    assert str(one(spark, X.dos_datetime(F.lit(word(2024, 2, 29, 23, 59, 29))))) == "2024-02-29 23:59:58"
    assert one(spark, X.dos_datetime(F.lit(word(2023, 2, 29, 0, 0, 0)))) is None
    assert one(spark, X.dos_datetime(F.lit(word(2023, 2, 28, 0, 0, 30)))) is None
    assert one(spark, X.ole_micros(F.lit(25569.5))) == 43_200_000_000
    assert one(spark, X.ole_micros(F.lit(-1.25))) == -25570 * 86_400_000_000 + 21_600_000_000


def test_clocks_are_exact(spark):
    rows = {r.clock: r for r in spark.range(1).select(F.inline(X.epoch_candidates(F.lit(133_485_408_001_234_567)))).collect()}
    assert int(rows["filetime"].micros) == 133_485_408_001_234_567 // 10 - 11_644_473_600 * 1_000_000 and rows["filetime"].plausible and not rows["unix_s"].plausible


def test_zone_less_time_is_never_utc_unless_told(spark):
    assert tuple(one(spark, X.to_utc(F.lit("2024-01-01T00:00:00")))) == (None, "none")
    assert one(spark, X.to_utc(F.lit("2024-01-01T00:00:00"), True)).basis == "assumed"
    assert one(spark, X.to_utc(F.lit("2024-01-01T01:00:00+01:00"))).micros == 1_704_067_200_000_000
    assert one(spark, X.to_utc(F.lit("soon"))).basis == "invalid"


def test_cells_and_numbers(spark):
    assert [one(spark, X.csv_safe(F.lit(v))) for v in ("=1", "-2", "a=", "@x")] == ["'=1", "'-2", "a=", "'@x"]
    assert one(spark, X.luhn(F.lit("4539578763621486"))) and not one(spark, X.luhn(F.lit("4539578763621487")))
    assert one(spark, X.entropy(F.lit("aabb"))) == 1.0
    assert one(spark, X.leading_command(F.lit("A=1 sudo /usr/bin/tar -x"))) == "tar"
    assert one(spark, P.refang(F.lit(" hxxps://a[.]b(.)c[:]8 "))) == "https://a.b.c:8"
    kinds = {"a" * 64: "sha256", "10.0.0.0/8": "ipv4", "x@y.org": "email", "b.org": "domain", "/etc/x": "path", "?": "untyped"}
    assert {v: one(spark, P.indicator_type(F.lit(v))) for v in kinds} == kinds


def test_leading_command_of_odd_texts(spark, tmp_path):
    """Empty texts, and white space of every kind in front, against the SQL."""
    duckdb = pytest.importorskip("duckdb")
    from casewright.plans import all_queries, all_sql

    texts = ["", " ", "\n", " \t\r\n", "\nls -l", "\t ls", " \r\n\fls\n", "\x0bls -l", " \x0b ls", "\x85ls", "\u00a0ls", "\u3000 ls", "ls", "sudo", "sudo ", "ls/x", "\n/x", "\ta=1 ls", "ls a=1 /x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(all_sql()["h14_leading_command"]).fetchall())
    assert dict(map(tuple, all_queries()["h14_leading_command"](spark, str(tmp_path)).collect())) == want and len(want) == 16
    lines = {"sudo /usr/bin/": "", "A=1 sudo /bin/ls -l": "ls", "sudo": "sudo", " sudo ": "sudo", "B=2 A= ls /x": "ls", "/a/b/": "", "": ""}
    assert {v: one(spark, X.leading_command(F.lit(v))) for v in lines} == lines


def test_a_bare_upper_date_covers_its_day(spark):
    df = spark.createDataFrame([("2024-01-02 23:59:59.999999",), ("2024-01-03 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert P.time_window(df, "t", None, "2024-01-02").count() == 1 and P.time_window(df, "t", "2024-01-03", "2024-01-03 00:00:00").count() == 1


def test_the_first_rule_counts(spark):
    got = P.account(spark.range(4), [("a", F.col("id") < 2), ("b", F.col("id") < 3)]).orderBy("id").collect()
    assert [r.left_out for r in got] == ["a", "a", "b", None]


def test_asof_takes_ties_and_leaves_gaps_null(spark):
    ts = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:00:{s:02d}"))
    left = spark.range(3).select(F.lit(1).alias("k"), "id", F.element_at(F.array(ts(0), ts(5), ts(9)), (F.col("id") + 1).cast("int")).alias("ts"))
    right = spark.range(2).select(F.lit(1).alias("k"), (F.col("id") + 10).alias("v"), F.element_at(F.array(ts(5), ts(7)), (F.col("id") + 1).cast("int")).alias("ts"))
    prev, nxt = (dict(J.asof(left, right, ["k"], "ts", "v", d).select("id", "near_value").collect()) for d in ("prev", "next"))
    assert prev == {0: None, 1: 10, 2: 11} and nxt == {0: 10, 1: 10, 2: None}
    assert dict(J.asof(left, right, ["k"], "ts", "v", "prev", "1000000").select("id", "near_value").collect()) == {0: None, 1: 10, 2: None}


def test_intervals_are_half_open_and_may_stay_open(spark):
    holds = spark.createDataFrame([(1, 0, 5), (1, 5, None)], "k int, f int, t int")
    got = I.interval_join(spark.createDataFrame([(1, 5), (1, 4), (2, 4)], "k int, at int"), holds, ["k"], "at", "f", "t").collect()
    assert sorted((r.at, r.f) for r in got) == [(4, 0), (5, 5)]
    assert S.concurrent(holds.select("k", F.col("f").cast("timestamp").alias("f"), F.col("t").cast("timestamp").alias("t")), ["k"], "f", "t").first().most == 1


def test_closure_and_groups_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    whole, cut = J.closure(edges, seeds, keep)
    assert sorted(map(tuple, whole.collect())) == [(1, 0), (2, 1), (3, 2)] and not cut
    part, cut = J.closure(edges, seeds, keep, 1)
    assert sorted(map(tuple, part.collect())) == [(1, 0), (2, 1)] and cut
    assert sorted(map(tuple, J.groups(edges.toDF("a", "b"), keep).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


def test_rounded_parts_add_up(spark):
    parts = spark.createDataFrame([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3), ("d", 2.0)], "k string, v double")
    got = dict(A.round_parts(parts, "k", "v", "k").collect())
    assert sum(got.values()) == 3 and got == {"a": 1, "b": 0, "c": 0, "d": 2}


def test_names_fold_to_one_form(spark):
    assert one(spark, J.fold_key(F.lit("  École\t Nord "))) == "école nord"


def test_needles_of_any_length(spark):
    """Every place of every needle, overlapping and repeated, in letters of any plane and as UTF-16LE bytes."""
    text = "aaaa evil.example.org aaaa 漢字😀x e\0v\0i\0l\0 evil" * 3
    needles = ["a", "aa", "aaa", "evil", "漢字", "😀", "evil.example.org", " aaaa 漢字😀x", "absent", text, ""]
    docs = spark.createDataFrame([(1, text), (2, "a"), (3, None)], "k long, t string")
    asked = spark.createDataFrame([*enumerate(needles), (99, None)], "n long, needle string")
    places = lambda t, w: {i + 1 for i in range(len(t) - len(w) + 1) if w and t[i : i + len(w)] == w}
    want = {(k, n, i) for n, w in enumerate(needles) for k, t in ((1, text), (2, "a")) for i in places(t, w)}
    sw = lambda *a, **b: [(r.k, r.n, r.at) for r in sweep(*a, keep, **b).collect()]
    got = sw(docs, "k", "t", asked, "n", "needle")
    assert set(got) == want and len(got) == len(want)
    assert set(sw(docs, "k", "t", asked, "n", "needle", portion=40)) == want
    more = {(1, 3, i) for i in places(text, "e\0v\0i\0l\0")}
    assert set(sw(docs, "k", "t", asked.where("n = 3"), "n", "needle", forms=("plain", "utf16"))) == {w for w in want if w[1] == 3} | more
    assert not sw(docs, "k", "t", asked.limit(0), "n", "needle")


def test_overlaps_by_cells(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(2), i, rng.choice([None, rng.randrange(1000)]), None) for i in range(80)]
    rows = [(k, i, f, None if rng.random() < 0.1 else (f or 0) + rng.choice([0, 3, 50, 900])) for k, i, f, _ in rows]
    df = spark.createDataFrame(rows, "k int, i int, f long, t long").select("k", "i", F.col("f").cast("timestamp").alias("f"), F.col("t").cast("timestamp").alias("t"))
    meet = lambda a, b: (a[2] is None or b[3] is None or a[2] <= b[3]) and (b[2] is None or a[3] is None or b[2] <= a[3])
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and meet(a, b)}
    got = [(r.a, r.b) for r in I.overlap_pairs(df, ["k"], "i", "f", "t").collect()]
    assert set(got) == want and len(got) == len(want)
    both = {(a[1], b[1]) for a in rows[:40] for b in rows[40:] if a[0] == b[0] and meet(a, b)}
    got = [(r.a, r.b) for r in I.overlap_join(df.where("i < 40"), df.where("i >= 40"), ["k"], "i", "f", "t").collect()]
    assert set(got) == both and len(got) == len(both)
    odd = df.select("k", "i", F.col("t").alias("f"), F.col("f").alias("t")).where("f > t")
    assert I.malformed(odd, "f", "t").count() == odd.count() > 0 and I.overlap_pairs(odd, ["k"], "i", "f", "t").count() == 0


def test_similar_pairs_by_hand(spark):
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    base = [rng.sample(vocabulary, 14) for _ in range(6)]
    rows = [(i, " ".join(rng.sample(b, len(b)) + rng.sample(vocabulary, rng.randrange(4)))) for i in range(90) for b in [rng.choice(base)]]
    rows += [(200, "too few"), (201, None), (202, rows[0][1])]
    df = spark.createDataFrame(rows, "i long, t string")
    members, classes = T.word_classes(df, "i", "t", keep)
    got = {(r.a, r.b) for r in T.similar_classes(classes, keep).collect()}
    first = {}
    for i, t in rows:
        s = frozenset((t or "").split())
        if len(s) >= 5:
            first.setdefault(s, i)
    want = {(min(a, b), max(a, b)) for s, a in first.items() for u, b in first.items() if a < b and len(s & u) >= 0.8 * len(s | u)}
    assert got == want and len(want) > 20
    # every text has a row, copies too, and no link is lost
    sets = {i: frozenset((t or "").split()) for i, t in rows if len(set((t or "").split())) >= 5}
    near = lambda s, u: len(s & u) >= 0.8 * len(s | u)
    links = {(i, first[s], sum(u == s for u in sets.values()) - 1, sum(near(s, u) for u in sets.values()) - 1) for i, s in sets.items()}
    assert {tuple(r) for r in T.similar_texts(df, "i", "t", keep).collect()} == links


def test_similar_texts_write_less_than_the_texts(spark, monkeypatch):
    import random

    for name, value in (("FREQUENT", 12), ("_PART", 1 << 12), ("BLOCK", 4)):
        monkeypatch.setattr(T, name, value, raising=False)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(900)]
    rows = []
    for i in range(240):
        if i % 3:
            text = rows[-1][1].split()
            for _ in range(rng.randrange(40)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        else:
            text = [vocabulary[min(int(rng.expovariate(0.004)), 899)] for _ in range(rng.choice([8, 60, 400]))] + ["".join(rng.choices("mnopqrstu", k=9)) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(text)))
    written = []

    def watched(df):
        out = keep(df)
        size = F.octet_length("words") if "words" in out.columns else F.size("w") * 8 if "w" in out.columns else F.lit(0)
        written.append(out.agg(F.sum(size)).first()[0] or 0)
        return out

    got = {(r.id, r.links) for r in T.similar_texts(spark.createDataFrame(rows, "i long, t string").coalesce(1), "i", "t", watched).collect()}
    sets = {i: frozenset(t.split()) for i, t in rows if len(set(t.split())) >= 5}
    links = {i: sum(len(s & u) * 5 >= 4 * len(s | u) for u in sets.values()) - 1 for i, s in sets.items()}
    assert got == set(links.items()) and sum(links.values()) > 100
    # a table of 64-bit hashes of all words, written twice, is longer than the texts
    assert 0 < sum(written) < sum(len(t) for _, t in rows)


def test_similar_texts_meet_in_portions(spark, monkeypatch):
    """Near copies by the hundred: pairs before they are compared, and sets beside them, are never written all at once, and each pair is found once."""
    import random

    for name, value in (("MET", 0), ("LEAST_MET", 800), ("SAMPLE", 2), ("SENT", 0), ("LEAST_SENT", 40), ("BLOCK", 8)):
        monkeypatch.setattr(T, name, value, raising=False)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(600)]
    base = [rng.sample(vocabulary, n) for n in (12, 30, 30, 90)]
    rows = [(i, " ".join({*base[i % 4], *rng.sample(vocabulary, rng.randrange(1 + len(base[i % 4]) // 6))})) for i in range(160)]
    sizes, all_there = [], []

    def watched(df):
        out = keep(df)
        sizes.append(out.count() if out.columns == ["a", "b"] else 0)
        all_there.append(out)
        return out

    members, classes = T.word_classes(spark.createDataFrame(rows, "i long, t string"), "i", "t", keep)
    got = [(r.a, r.b) for r in T.similar_classes(classes, watched).collect()]
    first = {}
    for i, t in rows:
        first.setdefault(frozenset(t.split()), i)
    want = {(min(a, b), max(a, b)) for s, a in first.items() for u, b in first.items() if a < b and len(s & u) * 5 >= 4 * len(s | u)}
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert sum(sizes) >= len(want) and max(sizes) < len(want) / 2
    # of the tables between, only the answer is still there
    assert {"/".join(f.split("/")[:-1]) for df in all_there for f in df.inputFiles() if Path(f.removeprefix("file:")).exists()} == {"/".join(f.split("/")[:-1]) for df in all_there if "jaccard" in df.columns for f in df.inputFiles()}


def test_groups_leave_only_their_answer(spark):
    """Of the tables that the rounds write, one is still there."""
    held = []

    def watched(df):
        held.append(keep(df))
        return held[-1]

    got = J.groups(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31)], "a int, b int"), watched)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30), (32, 30)}
    assert len(held) > 3 and len({str(Path(f).parent) for df in held for f in df.inputFiles() if Path(f.removeprefix("file:")).exists()}) == 1


def test_assignment_is_that_of_the_cheapest_first(spark):
    import random

    rng = random.Random(2)
    pairs = sorted({(a, rng.randrange(25)): rng.randrange(12) for a in [rng.randrange(30) for _ in range(200)]}.items(), key=lambda p: (p[1], p[0]))
    want, used = set(), (set(), set())
    for (a, b), c in pairs:
        if a not in used[0] and b not in used[1]:
            want.add((a, b, c))
            used[0].add(a), used[1].add(b)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in pairs], "a int, b int, c int")
    assert {tuple(r) for r in J.assign(df, "a", "b", "c", keep).collect()} == want
    assert J.assign(df.limit(0), "a", "b", "c", keep).count() == 0


def test_wall_clock_times(spark):
    """Both sides of a spring and an autumn change, against the zone table of Python."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    from casewright.operators import zones

    rows = [(z, datetime(2024, m, d) + timedelta(minutes=30 * k)) for z, m, d in (("Europe/Berlin", 3, 31), ("Europe/Berlin", 10, 27), ("America/New_York", 3, 10), ("America/New_York", 11, 3), ("Australia/Lord_Howe", 4, 7), ("UTC", 6, 1)) for k in range(12)]
    df = spark.createDataFrame([(i, z, t) for i, (z, t) in enumerate(rows)] + [(99, None, datetime(2024, 5, 5)), (100, "UTC", None)], "i int, zone string, t timestamp_ntz")
    got = {r.i: (r.us, r.or_us, r.basis) for r in zones.local_to_utc(df, "i", "t", "zone", zones.transitions(spark, df.select("zone"), 2024, 2024), keep).collect()}
    for i, (z, t) in enumerate(rows):
        made = {t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        made = sorted(u for u in made if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == t)
        us = [int(u.timestamp()) * 1_000_000 for u in made]
        assert got[i] == ((us[0], us[1], "ambiguous") if len(us) == 2 else (us[0], None, "converted") if us else (None, None, "non-existent"))
    assert {got[i][2] for i in range(len(rows))} == {"ambiguous", "converted", "non-existent"} and got[99] == (None, None, "no zone")


def test_event_records(spark):
    from casewright.sources.readers import parse_event_xml

    rows = ["<Event><System><EventID>zz</EventID></System><EventData><Data Name='a'>1</Data><Data Name='a'>2 &lt; 3</Data><Data> x </Data><Data Name='e'/></EventData></Event>", "<Event><System><EventID>1</System>", None, "", "<Event/>"]
    got = parse_event_xml(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string"), "x").collect()
    assert got[0].event_code is None and got[0].named == {"a": "2 < 3", "e": ""} and [tuple(x) for x in got[0].data] == [("a", "1"), ("a", "2 < 3"), (None, " x "), ("e", "")]
    assert got[1].rejected == rows[1] and got[2].rejected is None and got[2].data == [] and got[4].rejected is None


def test_tenths_round_to_even(spark):
    assert [one(spark, X.human_bytes(F.lit(n))) for n in (1280, 1792, 1536, 256 * 1024 * 5, 12)] == ["1.2 KB", "1.8 KB", "1.5 KB", "1.2 MB", "12 B"]


def test_beacon_without_times_and_with_a_long_end(spark):
    rows = [("a", t) for t in (0, 60, 120, 180, 240, 300, 1000)] + [("a", None), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.col("s").cast("timestamp").alias("ts"))
    r = A.beacon_score(df, ["k"], "ts", keep).first()
    assert (r.k, r.events, r.rejected, r.median_s, r.mad_s, r.long_final_gap, r["shape"]) == ("a", 7, 1, 60.0, 0.0, True, "tight_cluster")
    assert abs(r.density - 7 / (1000 / 60 + 1)) < 1e-9


def test_needles_at_every_offset(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    needles = spark.createDataFrame([(i, text[i : i + 31]) for i in range(0, 60)], "n long, needle string")
    got = sweep(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string"), "k", "t", needles, "n", "needle", keep).select("k", "n", "at").collect()
    assert sorted((r.n, r.at) for r in got) == [(i, text.index(text[i : i + 31]) + 1) for i in range(0, 60)]


def test_hidden_literals_at_every_phase(spark):
    import base64
    import codecs

    word = "hidden literal, ünïcode"
    texts = [base64.b64encode(b"x" * k + word.encode() + b"tail").decode() for k in range(6)] + [base64.b32encode(b"y" * k + word.encode() + b"tail").decode() for k in range(6)]
    texts += [word.encode().hex(), word.encode().hex().upper(), codecs.encode(word, "rot13"), base64.b64encode(b"hidden lateral, nothing").decode()]
    docs = spark.createDataFrame([(i, "before " + t + " behind") for i, t in enumerate(texts)], "k int, t string")
    got = sweep(docs, "k", "t", spark.createDataFrame([(1, word)], "n int, w string"), "n", "w", keep, ("hex", "base64", "base32", "rot13")).collect()
    assert sorted((r.k, r.form) for r in got) == [(i, "base64") for i in range(6)] + [(i, "base32") for i in range(6, 12)] + [(12, "hex"), (13, "hex"), (14, "rot13")]


def test_short_words_inside_longer_runs(spark):
    from casewright.operators.sweep import in_longer_run

    cases = [("pin 12", "345", " x", True), ("pin ", "345", " x", False), ("x ", "beef", "0123456789abcdef", True), ("x ", "beef", " cafe", False), ("aGVsbG8gd29y", "bGQh", "MTIzNDU2Nzg5", True), ("see the ", "key", " here", False), ("a/b/c/d/e/f/g1/", "word", "/h/i/j/k/l/m/n", False)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "b string, w string, e string, inside boolean, i int")
    assert all(r.inside == r.got for r in df.withColumn("got", in_longer_run(F.col("b"), F.col("w"), F.col("e"))).collect())


def test_copies_of_transfers_are_matched_together(spark):
    """Copies of transfers and items that all cost the same take a round, not one each; ids of several rows, ties between classes and odd sizes come out as the cheapest first."""
    import datetime
    import random

    rng = random.Random(9)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    written = []

    def watched(df):
        written.append(1)
        return keep(df)

    def matched(out, staged, percent=4):
        frames = (spark.createDataFrame(x, "id long, host long, size double, ts timestamp") for x in (staged, out))
        got = J.match_transfers(*frames, ["host"], "id", "size", "ts", percent, 7 * 86_400, watched).collect()
        pairs = sorted({(round(abs(o[2] - s[2]), 4), o[0], s[0]) for o in out for s in staged if o[1] == s[1] and datetime.timedelta(0) <= o[3] - s[3] <= datetime.timedelta(7) and abs(o[2] - s[2]) <= o[2] * percent / 100})
        want, a, b = set(), set(), set()
        for off, x, y in pairs:
            if x not in a and y not in b:
                want.add((x, y, off))
                a.add(x), b.add(y)
        assert {(r.transfer, r.staged, r.off) for r in got if r.status == "matched"} == want
        assert sum(r.status == "unmatched transfer" for r in got) == sum(o[0] not in a for o in out) and sum(r.status == "unmatched item" for r in got) == sum(s[0] not in b for s in staged)
        return len(want)

    assert matched([(i, 1, 100.0, day(9)) for i in range(40)] + [(i, 1, 200.0, day(9)) for i in range(40, 50)], [(i, 1, 101.0, day(5)) for i in range(30)] + [(i, 1, 203.0, day(4)) for i in range(30, 50)]) == 40
    assert len(written) < 30
    some = lambda n, ids, sizes: [(rng.randrange(ids), rng.randrange(2), float(rng.choice(sizes)), day(rng.randrange(9))) for _ in range(n)]
    assert matched(some(60, 1000, [100, 102]), some(60, 30, [99, 100, 101, 103])) > 10
    assert matched(some(40, 1000, [0, 5, 100, -3]), some(40, 60, [0, 5, -3, 104, 96])) > 10
    assert matched(some(20, 1000, [7]), some(20, 1000, [7, 8]), 0) > 3


def test_transfers_are_listed_by_rising_cost(spark, monkeypatch):
    """Every transfer fits most items of its host: pairs are listed some at a time, and settled as if all were; ids of several rows, sizes from nothing to much and ties among them."""
    import datetime
    import random

    for name, value in (("LISTED", 0), ("LEAST_LISTED", 400), ("SAMPLE", 1)):
        monkeypatch.setattr(J, name, value, raising=False)
    rng = random.Random(6)
    day = datetime.datetime(2024, 1, 9)
    some = lambda n, ids: [(rng.randrange(ids), rng.randrange(2), rng.choice([rng.randrange(9000, 9300) / 1, rng.randrange(9000, 9300) / 7, 0.0, rng.randrange(100) / 8]), day - datetime.timedelta(rng.randrange(3))) for _ in range(n)]
    out, staged = [(*o[:3], day) for o in some(120, 100)], some(130, 90)
    sizes, held = [], []

    def watched(df):
        held.append(keep(df))
        sizes.append(held[-1].count() if held[-1].columns == ["x", "y", "cost"] else 0)
        return held[-1]

    pairs = sorted({(round(abs(o[2] - s[2]), 4), o[0], s[0]) for o in out for s in staged if o[1] == s[1] and abs(o[2] - s[2]) <= o[2] * 4 / 100})
    want, a, b = set(), set(), set()
    for off, x, y in pairs:
        if x not in a and y not in b:
            want.add((x, y, off))
            a.add(x), b.add(y)
    frames = (spark.createDataFrame(x, "id long, host long, size double, ts timestamp") for x in (staged, out))
    got = J.match_transfers(*frames, ["host"], "id", "size", "ts", 4, 7 * 86_400, watched)
    assert {(r.transfer, r.staged, r.off) for r in got.collect() if r.status == "matched"} == want and len(want) > 50
    assert len(pairs) > 1500 and max(sizes) < 700 and sum(map(bool, sizes)) > 1
    assert len({str(Path(f).parent) for df in held for f in df.inputFiles() if Path(f.removeprefix("file:")).exists()}) == 1


def test_leaks_in_every_form(spark):
    import json

    from casewright.operators.sweep import leak_scan

    words = ['pa"ss\\word', "naïve-key", "7c1d"]
    digest = "ab" * 32
    texts = ["x " + json.dumps(words[0]) + " y", json.dumps(words[1]), "".join(c + "\0" for c in "a naïve-key b"), digest.upper() + " " + digest, "id 7c1d.", "ffff7c1d0123456789abcdef", words[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = leak_scan(df, "k", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w", "w", spark.createDataFrame([(9, digest)], "n int, h string"), "n", "h", keep).collect()
    assert sorted((r.k, r.kind, r.id, r.form, r.at) for r in got) == [(0, "word", words[0], "json", 4), (1, "word", words[1], "json", 2), (2, "word", words[1], "utf16", 5), (3, "digest", "9", "plain", 1), (3, "digest", "9", "plain", 66), (4, "word", "7c1d", "plain", 4), (6, "word", words[0], "plain", 1)]


def test_sweep_equals_a_search_word_by_word(spark):
    """Random texts, long ones cut in blocks, needles of all lengths up to longer than a block."""
    import random

    from casewright.operators import sweep as module

    rng = random.Random(6)
    texts = ["".join(rng.choices("abé", k=rng.choice([0, 5, 300, 5000]))) for _ in range(12)] + ["".join(rng.choices("abé漢", k=400_000))]
    needles = {t[a : a + n] for t in texts for n in (1, 2, 5, 9, 17, 31, 33, 64, 65, 200) for a in [rng.randrange(max(1, len(t) - n))] if n > 4 or len(t) < 400} | {texts[-1][100:300_000], texts[3]}
    needles = sorted(n for n in needles if n)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [(r.k, r.n, r.at) for r in sweep(df, "k", "t", spark.createDataFrame(list(enumerate(needles)), "n int, w string"), "n", "w", keep).collect()]
    want = set()
    for i, t in enumerate(texts):
        for n, w in enumerate(needles):
            at = t.find(w)
            while at >= 0:
                want.add((i, n, at + 1))
                at = t.find(w, at + 1)
    assert set(got) == want and len(got) == len(want) and len(texts[-1].encode()) > 2 * module.BLOCK


def test_long_needles_are_sent_as_hashes(spark):
    """What is sent does not grow with a needle's length, so the texts are read once where they were read 40 times; no object is held a needle."""
    import tracemalloc

    import numpy as np

    from casewright.operators import sweep as module

    texts = [f"{i} " * 2_000 for i in range(100, 140)]
    docs, needles = (spark.createDataFrame(list(enumerate(texts)), "k int, t string") for _ in range(2))
    got = sweep(docs, "k", "t", needles.withColumnRenamed("k", "n"), "n", "t", keep, portion=4_096)
    assert "Union" not in got._jdf.queryExecution().toString()
    assert sorted((r.k, r.n, r.at) for r in got.collect()) == [(i, i, 1) for i in range(40)]
    words = spark.range(200_000).select("id", F.concat(F.lit("secret-"), F.col("id").cast("string")).alias("w"))
    sent = module._prepared(words, ["plain"], True).toPandas()
    arrays = [sent[c].to_numpy() for c in ("size", "first", "last")]
    tracemalloc.start()
    held = module.Needles(arrays[0], arrays[1].view(np.uint64), arrays[2].view(np.uint64), np.frombuffer(b"".join(sent["mark"]), np.uint8))
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held.size) == 200_000 and grown < 200 * 200_000


def test_phrases_are_whole_words_of_any_script(spark):
    texts = ["no", "NO!", "noć", "año no", "éno", "no\u0301", "no_", "9no", "was\nthis", "thiſ", "«no»", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.flag_phrases(F.col("t"), ("this", "was", "no")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {0: ["no"], 1: ["no"], 3: ["no"], 8: ["this", "was"], 9: ["this"], 10: ["no"]} | {i: [] for i in (2, 4, 5, 6, 7, 11, 12)}
