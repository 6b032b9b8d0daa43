"""Sources, decisions and stateful streams against golden cases."""

import csv
import io
import json
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from contrail.functions import decisions, platforms, settings
from contrail.operators import actions, contexts, tracks
from contrail.sources import corpus, recorder, wire
from contrail.streaming import timeline


PLACE = "<Location><Longitude>{}</Longitude><Latitude>{}</Latitude><Altitude>{}</Altitude></Location>"


def event(t, place, obj=None, rest=""):
    lon, lat, alt = place
    obj = "" if obj is None else obj
    return (f"<Event><Time>{t}</Time>" if t is not None else "<Event>") + PLACE.format(lon, lat, alt) + obj + rest + "</Event>"


def unit(i, side="Red", kind="Aircraft", more="<Name>F</Name><Pilot>{0}p</Pilot>"):
    return f'<PrimaryObject ID="{i}"><Type>{kind}</Type>{more.format(i)}' + (f"<Coalition>{side}</Coalition>" if side else "") + "</PrimaryObject>"


FIRED = '<SecondaryObject ID="m"><Name>AIM</Name></SecondaryObject><Action>HasFired</Action>'


def recording(spark, tmp_path, events):
    (tmp_path / "r.xml").write_text(f"<R><Events>{''.join(events)}</Events></R>")
    return recorder.read_xml(spark, str(tmp_path / "r.xml"))


def test_xml_events(spark, tmp_path):
    a = '<PrimaryObject ID="a"><Type>Aircraft</Type><Name>F</Name><Pilot/><Coalition>Red</Coalition></PrimaryObject>'
    bare = '<PrimaryObject><Type>Aircraft</Type></PrimaryObject>'
    p = (1, 2, 3)
    events = [event(1.5, p, a), event(2, p, a, '<SecondaryObject ID="m"/><Action>HasFired</Action>'), event("x", p, a), event(3, p), event(None, p, a), event(4, (1, "", 3), a), event(5, p, bare, "<Action>HasFired</Action>"), event(6, p, a, '<SecondaryObject ID="m"><Name/></SecondaryObject><Action>HasFired</Action>')]
    got = recording(spark, tmp_path, events).orderBy("seq").collect()
    # a missing element is Unknown, an empty one null
    assert [(r["t"], r["obj_id"], r["pilot"], r["side"], r["country"], r["launch"], r["weapon_name"]) for r in got] == [(1.5, "a", None, "Red", "Unknown", False, None), (2.0, "a", None, "Red", "Unknown", True, "Unknown Weapon"), (5.0, None, "Unknown", "Unknown", "Unknown", False, None), (6.0, "a", None, "Red", "Unknown", True, None)]


def distance(p, q):
    rad = math.radians
    h = math.sin((rad(q[1]) - rad(p[1])) / 2) ** 2 + math.cos(rad(p[1])) * math.cos(rad(q[1])) * math.sin((rad(q[0]) - rad(p[0])) / 2) ** 2
    return math.hypot(2 * 6371 * math.asin(math.sqrt(h)), (q[2] - p[2]) / 1000)


def test_xml_to_launches_and_enemies(spark, tmp_path):
    """From the file on: registration by type, first attributes, ties of time and distance, the edge of the window."""
    b2 = unit("b", "Red")  # changed coalition: the first holds
    events = [
        event(100, (0, 0, 1000), unit("c", "Blue", "Weapon"), FIRED),  # not an aircraft yet
        event(10, (0, 0, 1000), unit("a")),
        event(9.5, (0.2, 0, 1000), unit("b", "Blue")),
        event(10, (0.1, 0, 1000), b2),
        event(10, (0.1, 0, 1000), unit("d", "Blue")),  # as far as b at the same time, later in the document
        event(10, (0.01, 0, 1000), unit("w", "Blue", "Weapon")),  # nearest, but no aircraft
        event(10, (0.02, 0, 1000), unit("e", "Red")),  # same side
        event(12, (0, 0, 2000), unit("a", "Red", "Missile"), FIRED),  # registered earlier, this row is no position
        event(15, (0, 0, 2000), unit("a"), FIRED),
        event(20, (0.3, 0, 1000), unit("b", "Blue")),  # exactly five seconds after
        event(40, (0, 0, 0), unit("a"), FIRED),  # nobody near
        event(50, (0, 0, 0), unit("n", None)),
        event(50, (0.5, 0, 0), unit("a"), FIRED),  # a missing coalition is a side, Unknown
        event(50.5, (0, 0, 0), unit("ghost", "Blue", "Weapon"), FIRED),
    ]
    rows = recording(spark, tmp_path, events)
    near = {r["t"]: r for r in tracks.nearest_enemy(rows, 5.0, ("side", "pilot", "name", "group"), ("weapon_name",)).collect()}
    assert sorted(near) == [12.0, 15.0, 40.0, 50.0]
    assert (near[12.0]["enemy_id"], near[12.0]["enemy_t"], near[12.0]["enemy_pilot"]) == ("b", 10.0, "bp")
    assert abs(near[12.0]["dist"] - distance((0, 0, 2000), (0.1, 0, 1000))) < 1e-9 and abs(near[12.0]["brg"] - 90) < 1e-9
    assert (near[15.0]["enemy_id"], near[15.0]["enemy_t"]) == ("b", 10.0)
    assert near[40.0]["enemy_id"] is None and near[40.0]["dist"] == 0 and near[40.0]["brg"] is None
    assert near[50.0]["enemy_id"] == "n" and near[50.0]["enemy_side"] == "Unknown"
    idx = {r["t"]: r["idx"] for r in tracks.numbered(tracks.launches(rows)).collect()}
    assert [idx[t] for t in (12.0, 15.0, 40.0, 50.0)] == [1, 2, 3, 4]
    snaps = tracks.nearest_of_snapshots(tracks.snapshots(rows)).collect()
    got = {(r["launch_t"], r["t"]): (r["enemies"], r["enemy_id"]) for r in snaps}
    assert got == {(12.0, 10.0): (2, "b"), (12.0, 15.0): (0, None), (15.0, 10.0): (2, "b"), (15.0, 15.0): (0, None), (40.0, 40.0): (0, None), (50.0, 50.0): (1, "n")}
    total = tracks.launch_totals(rows).first()  # of the one recording
    assert (total["launches"], total["allies"], total["enemies"]) == (4, 0, 0)


def exported(folder):
    """The files of a folder as one text."""
    got = b"".join(p.read_bytes() for p in sorted(folder.parent.glob(f"{folder.name}/part-*")))
    assert got.startswith(b"\xef\xbb\xbf")
    return got.decode("utf-8-sig")


def test_exports_equal_a_csv_writer(spark, tmp_path):
    """Several files, odd fields, and an empty line after each launch: what a writer of one file would have put there."""
    rows = [(n, f"{t:.2f}", text) for n in range(1, 13) for t in (9.5, 10.0, 100.25, -1.0) for text in ("a", 'say "x"', "b,c", "d\r\ne", "  f ", None)]
    df = spark.createDataFrame(rows, "n int, t string, said string")
    tracks.write_table(df.repartition(7), str(tmp_path / "one"), "n", "t", "said", gaps=True)
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(df.columns)
    for n in range(1, 13):
        writer.writerows(sorted((r for r in rows if r[0] == n), key=lambda r: (float(r[1]), r[2] is not None, r[2] or "")))
        writer.writerow([])
    assert exported(tmp_path / "one") == out.getvalue()
    two = df.where("n < 3").withColumn("recording", F.concat(F.lit("r"), F.col("n") % 2))
    tracks.write_table(two, str(tmp_path / "two"), "n", "t", "said", gaps=True)
    parts = [exported(tmp_path / "two" / f"recording=r{n}") for n in (1, 0)]
    assert [list(csv.reader(io.StringIO(p, newline="")))[0] for p in parts] == [df.columns] * 2
    assert [p.count("\r\n\r\n") for p in parts] == [1, 1]
    tracks.write_table(df.limit(0), str(tmp_path / "none"), "n", gaps=True)
    assert exported(tmp_path / "none") == "n,t,said\r\n"


def test_exports(spark, tmp_path):
    events = [event(1, (0, 0, 1000), unit("a", "Allies", more="<Name>F,1</Name><Pilot/><Group>G</Group>")), event(1, (0.1, 0, 900), unit("b", "Enemies")), event(2, (0, 0, 1000), unit("a"), FIRED), event(90, (0, 0, 30), unit("a"), FIRED)]
    rows = recording(spark, tmp_path, events)
    tracks.write_table(tracks.launch_table(rows), str(tmp_path / "launches"), tracks.LAUNCH_HEADER[0])
    lines = exported(tmp_path / "launches" / "recording=*").splitlines()
    d = distance((0, 0, 1000), (0.1, 0, 900))
    assert lines[0] == ",".join(tracks.LAUNCH_HEADER)
    assert lines[1] == f'1,2.00,,"F,1",Allies,G,AIM,0.000000,0.000000,1000.0,3281,bp,F,Enemies,{d:.2f},{d * 0.539957:.2f},0.100000,0.000000,900.0,2953,-100.0,-328,90.0'
    assert lines[-1] == '2,90.00,,"F,1",Allies,G,AIM,0.000000,0.000000,30.0,98' + "," * 12
    series = [tuple(r) for r in tracks.series_table(rows).drop("recording").orderBy(*tracks.SERIES_HEADER[:1], tracks.SERIES_HEADER[5]).collect()]
    assert [r[:6] for r in series] == [(1, None, "AIM", "bp", "-1.00", "1.00"), (1, None, "AIM", "bp", "0.00", "2.00"), (2, None, "AIM", "Unknown", "0.00", "90.00")]
    assert [r[10:13] for r in series] == [(1, "bp", f"{d:.2f}")] * 2 + [(0, "", "")]
    said = {r["idx"]: r["summary"] for r in tracks.launch_summary(rows).collect()}
    assert "发射者: None (F,1)" in said[1] and "高度差: -100m (-328ft)" in said[1] and "未找到敌机" in said[2]


LINES = ["FileType=text", "#0.5", "401,T=1|2|3|4|5|6|7,x", "b,T=2|2", "c,T=1|q|3", "-b", "#1.0", "b,T=5||7", "#2.0", "401,T=9|9|9|9|9|9"]


@pytest.mark.parametrize("block", [2, 4096])
def test_recordings(spark, tmp_path, block):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme", "no")
        z.writestr("r.txt.acmi", "\n".join(LINES))
    (tmp_path / "b.zip").write_bytes(b"PK broken")
    lines = recorder.read_recordings(spark, str(tmp_path), lines_per_batch=3)
    assert lines.where("error is not null").count() == 1
    records = recorder.telemetry(lines, block)
    got = sorted((r["frame_no"], r["frame_t"], r["obj_id"], r["lon"], r["lat"], r["yaw"]) for r in records.collect())
    assert got == [(1, 0.5, "401", 1.0, 2.0, 6.0), (1, 0.5, "b", 2.0, 2.0, 0.0), (2, 1.0, "b", 5.0, 0.0, 0.0)]
    ego = sorted((r["frame_no"], list(r["ego"]), r["agent_id"], list(r["agent"])) for r in recorder.ego_frames(records, recorder.frames(lines, block), "401").collect())
    assert ego == [(1, [0, 0, 3, 4, 5, 6, 0, 0, 0], "b", [1, 0, -3, -4, -5, -6, 0, 0, 0]), (2, [0, 0, 3, 4, 5, 6, 0, 0, 0], "b", [4, -2, 4, -4, -5, -6, 0, 0, 0])]


def framed(spark, lines, **options):
    df = spark.createDataFrame([("f", i, x, None) for i, x in enumerate(lines)], "file string, line_no long, line string, error string")
    return recorder.telemetry(df, **options), recorder.frames(df)


def test_empty_and_removal_frames(spark):
    """A frame without lines gives nothing, one with any line all that is known; agents are numbered as first met."""
    records, frames = framed(spark, ["#0", "z,T=1|1|1", "e,T=0|0|0", "b,T=2|2|2", "#1", "#2", "-b", "#3", "b,T=3|3|3", "#4", "", "#5"])
    got = sorted((r["frame_no"], r["agent_no"], r["agent_id"], r["agent"][0]) for r in recorder.ego_frames(records, frames, "e").collect())
    assert got == [(1, 1, "z", 1.0), (1, 2, "b", 2.0), (3, 1, "z", 1.0), (3, 2, "b", 2.0), (4, 1, "z", 1.0), (4, 2, "b", 3.0), (5, 1, "z", 1.0), (5, 2, "b", 3.0)]


def test_partial_records(spark):
    lines = ["#0", "e,T=0|0|0", "b,T=1|2|3|4|5|6", "#1", "b,T=9|8|x|1|1|1", "#2", "b,T=x|1", "#3"]
    records, frames = framed(spark, lines, partial=True)
    got = {r["frame_no"]: list(r["agent"])[:6] for r in recorder.ego_frames(records, frames, "e").collect()}
    assert got == {1: [1, 2, 3, 4, 5, 6], 2: [9, 8, 3, 4, 5, 6], 3: [9, 8, 3, 4, 5, 6]}
    whole, _ = framed(spark, lines)
    assert whole.count() == 2


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "A.DOCX", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>é</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"pdf")
    (tmp_path / "d.txt").write_bytes(b"no")
    df = corpus.read_documents(spark, str(tmp_path), {".pdf": lambda b: b.decode() + "!"})
    assert {r["path"].rpartition("/")[2]: r["text"] for r in df.collect()} == {"A.DOCX": "one é\n", "b.docx": "", "c.pdf": "pdf!"}
    corpus.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(json.loads(x)["text"] for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()) == ["", "one é\n", "pdf!"]


def test_wire(spark):
    df = spark.createDataFrame([("1.5 2 3 4",), ("1 2 3",), ("1 0",), ("x 1 2",), ("",), (None,)], "s string").select(wire.token_frame(F.col("s")).alias("f"))
    assert [None if r["f"] is None else (r["f"]["sim_time"], list(r["f"]["vals"])) for r in df.collect()] == [(1.5, [3, 4]), None, (1.0, []), None, None, None]
    data = struct.pack("<Iff", 8, 1.5, 2.0) + struct.pack("<I", 0) + struct.pack("<I3s", 3, b"abc") + struct.pack("<If", 8, 1.0)
    got = wire.binary_messages(spark.createDataFrame([("p", data), ("q", None)], "path string, content binary")).orderBy("pos").collect()
    assert [(r["pos"], r["vals"], r["error"] is None) for r in got] == [(0, [1.5, 2.0], True), (1, [], True), (2, None, False)]
    replies = [r["reply"] for r in wire.halved(wire.binary_messages(spark.createDataFrame([("p", data)], "path string, content binary"))).orderBy("pos").collect()]
    assert [None if r is None else bytes(r) for r in replies] == [struct.pack("<Iff", 8, 0.75, 1.0), struct.pack("<I", 0), None]
    out = spark.createDataFrame([([1.0],)], "v array<float>").select(wire.packed("v").alias("p"), wire.reply(F.lit("STATUS"), decisions.action_vector(F.array(*[F.lit(1.0).cast("float")] * 6))).alias("s"), wire.reply(F.lit("RESET"), "v").alias("r")).first()
    assert bytes(out["p"]) == struct.pack("<If", 4, 1.0) and bytes(out["r"]) == b"RESET"
    vector = struct.unpack("<640f", bytes(out["s"])[6:])
    assert [i for i, x in enumerate(vector) if x] == [0, 1, 2, 8, 9, 10]


def test_decision_steps(spark):
    turn = {"red_1": {"turn_deg": 90, "up_m": -1000}}
    cases = [
        (json.dumps(turn | {"hold_s": 2}), [(2.0, [1, -0.5, 0, 0, 0, 0])]),
        (json.dumps({"steps": [turn, {"t": 2, "red2": {"dspeed_mps": 15}}, 7, {"hold_s": 0}, {"hold_s": "x"}, {"hold_s": 12}, {"hold_s": 1}]}), [(1.0, [1, -0.5, 0, 0, 0, 0]), (2.0, [0, 0, 0, 0, 0, 0.1]), (1.0, [0] * 6)]),
        (json.dumps({"steps": None, "sequence": [turn], "duration_s": -1}), [(1.0, [0] * 6)]),
        (json.dumps({"sequence": [turn]}), [(1.0, [1, -0.5, 0, 0, 0, 0])]),
        (json.dumps({"red_1": 5, "red1": {"turn_deg": 45}}), [(1.0, [0] * 6)]),
        ("```json\n" + json.dumps(turn) + "\n```", [(1.0, [1, -0.5, 0, 0, 0, 0])]),
        ("```" + json.dumps(turn) + "```", [(1.0, [0] * 6)]),
        ("[1]", [(1.0, [0] * 6)]),
        ("no json", [(1.0, [0] * 6)]),
        (None, [(1.0, [0] * 6)]),
        (json.dumps({"steps": [{"hold_s": 1}] * 20}), [(1.0, [0] * 6)] * 12),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string").select("i", decisions.decision_steps(F.col("s")).alias("d"))
    for r in df.collect():
        assert [(x["hold"], [round(v, 6) for v in x["action"]]) for x in r["d"]] == cases[r["i"]][1], cases[r["i"]]


def test_planner_decision(spark):
    rows = ['{"action": "execute", "plan": "p"}', '```json\n{"action": "end", "answer": "a"}\n```', '{"plan": "q"}', '{"x": 1}', "bad"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = {m: [tuple(r["d"]) for r in df.select("i", decisions.planner_decision(F.col("s"), m).alias("d")).orderBy("i").collect()] for m in ("route", "default", "plan")}
    assert got["route"] == [("execute", "p", None), ("end", None, "a"), ("execute", "q", None)] + [("execute", decisions.PARSE_FAILED + s, None) for s in rows[3:]]
    assert got["default"] == [("execute", "p", None), ("execute", "intercept", None), ("execute", "q", None), ("execute", "intercept", None), ("execute", "intercept", None)]
    assert [x[1] for x in got["plan"]] == ["p", '{"action":"end","answer":"a"}', "q", '{"x":1}', "bad"]


def test_context_units(spark):
    unit = lambda h, p: f"  {{'state': {{'heading': {h}, 'position': {p}, 'speed': 250}}}},"
    text = "\n".join([unit(1, "(0, 0, 0)"), "红方 {ignored}", unit(0, "(5, -2.5, 500)"), "{'bad'}", unit(90, "(1, 2, 3)"), "蓝方", unit(10, "(7,8,9)")])
    got = spark.createDataFrame([(text,), (None,)], "s string").select(decisions.context_units(F.col("s")).alias("u")).collect()
    assert [(u["unit"], u["heading"], u["x"], u["y"], u["z"], u["speed"]) for u in got[0]["u"]] == [("red1", 0, 5, -2.5, 500, 250), ("red2", 90, 1, 2, 3, 250), ("blue1", 10, 7, 8, 9, 250)]
    assert got[1]["u"] is None


def simulated(frames, decided):
    """The timeline one event at a time: frames before decisions of the same time."""
    queue, last, out = [], None, {}
    for t, kind, x in sorted([(t, 0, seq) for seq, t in frames] + [(t, 1, (h, a)) for t, h, a in decided], key=lambda e: e[:2]):
        if kind == 0:
            while queue and t > queue[0][0]:
                queue.pop(0)
            if queue:
                last = queue[0][1]
            out[x] = ("active" if queue else "held" if last is not None else "none", last if last is not None else "-")
        else:
            ends = [(t + sum(x[0][: i + 1]), a) for i, a in enumerate(x[1])]
            queue = queue + ends if queue and queue[-1][0] > t else ends
            last = queue[0][1]
    return out


def test_batch_timeline_against_simulation(spark):
    random.seed(4)
    frames, decided, want = [], [], {}
    for e in range(12):
        own = sorted(random.sample(range(1000), 60))
        said = [(float(t), [float(random.choice([1, 5, 30, 90])) for _ in range(random.choice([1, 2, 4]))]) for t in sorted(random.sample(range(1000), 12))]
        said = [(t, h, [f"{e}.{t}.{i}" for i in range(len(h))]) for t, h in said]
        frames += [(e, e * 1000 + t, float(t)) for t in own]
        decided += [(e, *x) for x in said]
        want |= simulated([(e * 1000 + t, float(t)) for t in own], said)
    f = spark.createDataFrame(frames, "episode long, seq long, t double")
    d = spark.createDataFrame(decided + [(99, 1.0, [], [])], "episode long, t double, holds array<double>, actions array<string>")
    got = {r["seq"]: (r["status"], r["action"]) for r in actions.answered(f, d, F.lit("-")).collect()}
    assert got == want
    assert actions.answered(f.limit(0), d, F.lit("-")).count() == 0
    assert {r["status"] for r in actions.answered(f, d.limit(0), F.lit("-")).collect()} == {"none"}


def test_settings():
    env = {"RESET_TIME_THRESHOLD": "7", "EXECUTOR_MAX_SEQUENCE_STEPS": "3.9", "PLANNER_REFRESH_INTERVAL_S": "", "EXECUTOR_TARGET_HORIZON_S": "x", "SYSTEM_TASK_DEFAULT": ""}
    got = settings.Settings.read(env)
    assert (got.reset_after, got.max_steps, got.refresh, got.horizon, got.task, got.hold) == (7.0, 3, 10.0, 3.0, "作战模拟", 1.0)


def test_frame_text(spark):
    vals = [1.0, 0.1, 2.5, 1e-05, 0.0, -1.0, 1e20, 90.0] * 4
    rows = [(1, 2.345, vals), (2, 1.0, vals[:31]), (3, 1.0, None), (4, 1.0, [float("nan"), *vals[1:]]), (5, None, vals)]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t double, v array<double>").select("i", platforms.context_text("t", "v").alias("s")).collect()}
    one = "{'live': 1, 'lat': 0.1, 'lon': 2.5, 'alt_m': 1e-05, 'velN_mps': 0.0, 'velE_mps': -1.0, 'velD_mps': 1e+20, 'heading_deg': 90.0}"
    assert got[1] == "T=2.35\n" + "".join(f"{n}: {one}\n" for n in ("red_1", "red_2", "blue_1", "blue_2")) or got[1].startswith("T=2.34")
    assert got[2] == "T=1.00 (state too short: 31)" and got[3] == "T=1.00 (state too short: None)"
    assert got[4].startswith("Data Error: ") and got[5] is None


def test_context_execute(spark):
    state = lambda h, p: f"{{'state': {{'heading': {h}, 'position': {p}, 'speed': 250}}}}"
    first = f"{decisions.RED}\n{state(0, '(0, 0, 5000)')}\n{decisions.BLUE}\n{state(0, '(5000, 5000, 5000)')}"
    rows = [(1, first, "intercept"), (2, first, "Retreat!"), (3, first, "爬升"), (4, first.split(decisions.BLUE)[0], None), (5, None, "climb"), (6, first.replace("(5000, ", "(-5000, "), "x")]
    got = {r["ctx"]: r["line"] for r in contexts.execute(spark.createDataFrame(rows, "ctx int, context string, plan string")).collect()}
    assert got == {1: "##red1 turn 30##", 2: "##red1 turn 60##", 3: "##red1 up 100##", 4: "####", 5: "####", 6: "##red1 turn -30##"}


def test_paced_stream(spark, tmp_path):
    seen = []
    rate = spark.readStream.format("rate").option("rowsPerSecond", 20).load()
    assert timeline.run_paced(rate, lambda batch, _: seen.append(batch.count()), seconds=0.5, rounds=3) == 3 and len(seen) == 3


def _streamed(spark, tmp_path, schema, batches, operator):
    """The rows that a stream of one file a batch gives, in a memory table."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{i}"))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = operator(df).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("streamed").collect()


def test_reassembled_frames(spark, tmp_path):
    got = _streamed(spark, tmp_path, "conn string, packet long, data string", [[("a", 0, "1.5 2 3"), ("a", 1, ".5 4 2")], [("a", 2, " 1 9 ")]], timeline.reassemble)
    assert sorted((r["sim_time"], list(r["vals"])) for r in got) == [(1.5, [3.5, 4.0]), (2.0, [9.0])]


def test_timeline(spark, tmp_path):
    a, b, c = [1.0], [2.0], [3.0]
    frames = [
        [("e", 0, 0.0, "go ", [1.0, 1.0], [a, b]), ("e", 1, 0.5, "later", [2.0], [c])],
        [("e", 2, 1.5, None, None, None), ("e", 3, 2.4, None, None, None), ("e", 4, 10.0, "failed", None, None), ("e", 5, 5000.5, None, [1.0], [a]), ("e", 6, 11.0, "new", [1.0], [b]), ("e", 7, 11.5, None, None, None)],
    ]
    got = _streamed(spark, tmp_path, "episode string, seq long, sim_time double, plan string, holds array<double>, actions array<array<double>>", frames, timeline.act)
    got = sorted((r["seq"], r["message"], r["action"], r["plan"]) for r in got)
    d = timeline.DEFAULT_PLAN
    assert got == [(0, "STATUS", [], d), (1, "STATUS", a, "go"), (2, "STATUS", b, "go"), (3, "STATUS", c, "go"), (4, "STATUS", c, "go"), (5, "RESET", None, None), (6, "STATUS", c, "failed"), (7, "STATUS", b, "failed")]  # a failed decision's plan holds
