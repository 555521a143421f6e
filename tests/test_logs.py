"""Time reports and id lists against plain loops over lines."""

import random
from datetime import datetime, timedelta

import pytest

from volspark.operators import logs as L

DAY = datetime(2016, 1, 21, 10, 0, 0)


def log_file(rng, n):
    """Headings, commands, messages, stage marks, ends and timing lines in any order."""
    names, lines, now = ["recon-all", "mri_convert", "all", "ln"], [], DAY
    for _ in range(n):
        now += timedelta(seconds=rng.randrange(1, 90))
        name = rng.choice(names)
        date = now.strftime("%a %b %d %H:%M:%S UTC %Y")
        lines.append(
            rng.choice(
                [
                    f"====== Part {rng.randrange(5)} of it ======", "====== iteration 3", "====== DONE ======", f"  /opt/{name} -i a -o b", f"time {name} x", f"{name}", f"{name} done",
                    f"#@# Stage {rng.randrange(9)} lh {date}", "#@# 241395 lh 227149", f"status: Ended {date}", "just some text", f"{name}\tx y",
                    now.strftime("@#@FSTIME %Y:%m:%d:%H:%M:%S ") + f"{name} N 2 e {rng.randrange(1000) / 8} S 0.05 U 1.64 P 77% M 236 F 0 R 55 W 0 c 7 w 3 I 0 O 20",
                    now.strftime("@#@FSTIME %Y:%m:%d:%H:%M:%S ") + "recon-all N 2 e 5.5 S 0.05 U 1.64 P 77% M 236 F 0 R 55 W 0 c 7 w 3 I 0 O 20",
                    "@#@FSTIME cmdf whatever",
                ]
            )
        )
    return lines


def brute(lines):
    """Times and stages the way one reads a log: backwards for the command, forwards for its stages."""
    times, stages, section = [], [], None
    date = lambda words: datetime.strptime(" ".join([*words[-5:-2], words[-1]]), "%b %d %H:%M:%S %Y")
    for i, line in enumerate(lines):
        if "======" in line and "teration" not in line and line.strip("= ") != "DONE":
            section = line.strip("= ").replace(" ", "-")
        if L.TIMING_MARK not in line or "cmdf" in line or line.split()[2] in L.QUIET_COMMANDS:
            continue
        cmd, seconds = line.split()[2], float(line.split()[6])
        at = next((j for j in range(i - 1, -1, -1) if cmd + " " in lines[j] and not any(w in lines[j] for w in L.NOT_A_COMMAND)), None)
        if at is None:
            continue
        times.append((i, section, cmd, lines[at].lstrip(" "), seconds))
        if cmd != "recon-all":
            continue
        opened = None
        for j in range(at, i):
            words = lines[j].split()
            if L.STAGE_MARK in lines[j] and len(words) > 5:
                if opened:
                    stages.append((i, j, opened[0], opened[1], date(words)))
                opened = (" ".join(words[1:-6]), date(words))
            if "Ended" in lines[j] and opened:
                stages.append((i, j, opened[0], opened[1], date(words)))
    return times, stages


@pytest.mark.parametrize("chunk", [5, 65_536])
def test_times_and_stages(spark, chunk):
    rng = random.Random(4)
    files = {f"f{k}": log_file(rng, n) for k, n in enumerate((400, 60, 3, 1))}
    df = spark.createDataFrame([(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)], "file string, line_no int, line string")
    times, stages = [], []
    for f, lines in files.items():
        a, b = brute(lines)
        times += [(f, *r) for r in a]
        stages += [(f, *r) for r in b]
    got = L.command_times(df, chunk=chunk).collect()
    assert sorted((r["file"], r["line_no"], r["section"] or "", r["cmd"], r["command"], r["elapsed_s"]) for r in got) == sorted((*r[:2], r[2] or "", *r[3:]) for r in times)
    assert all(r["stop"] - r["start"] == timedelta(seconds=r["elapsed_s"]) for r in got)
    naive = lambda t: datetime(*t.timetuple()[:6])
    got = L.command_stages(df.filter("TRUE"), chunk=chunk).selectExpr("file", "timed_at", "line_no", "stage", "date_format(start, 'yyyyMMddHHmmss') AS a", "date_format(stop, 'yyyyMMddHHmmss') AS b", "duration_s").collect()
    stamp = "%Y%m%d%H%M%S"
    want = [(f, i, j, s, naive(a).strftime(stamp), naive(b).strftime(stamp), (b - a).total_seconds()) for f, i, j, s, a, b in stages]
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_another_layout_of_a_timing_line_is_an_error(spark):
    df = spark.createDataFrame([("f", 0, "@#@FSTIME 2016:01:21:10:00:00 tool N 2 x 3.0")], "file string, line_no int, line string")
    with pytest.raises(Exception, match="unexpected timing line"):
        L.command_times(df).collect()


@pytest.mark.parametrize("chunk", [4, 4096])
def test_id_lists(spark, chunk):
    rng = random.Random(5)
    groups = {1: list(range(0, 40)), 2: rng.sample(range(-30, 60), 60), 3: [7], 4: [3, 4, 8, 9, 10, 11, 12, 20], 5: list(range(-9, 9)) + list(range(12, 16))}
    text = {}
    for g, ids in groups.items():
        runs = []
        for v in sorted(ids):
            if runs and runs[-1][1] == v - 1:
                runs[-1][1] = v
            else:
                runs.append([v, v])
        text[g] = ",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)
    rows = [(g, v) for g, ids in groups.items() for v in ids + ids[:3]]
    got = L.sequence_runs(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", chunk).collect()
    assert {r["g"]: r["text"] for r in got} == text


def test_stages_of_lines_that_are_far_apart(spark):
    far = 10**12
    lines = [
        (1, " /bin/recon-all -s a"), (5, "#@# One lh Thu Jan 21 18:27:08 UTC 2016"), (far, "#@# Two lh Thu Jan 21 18:28:08 UTC 2016"),
        (2 * far, "@#@FSTIME 2016:01:21:18:29:00 recon-all N 2 e 5.5 S 0.05 U 1.64 P 77% M 236 F 0 R 55 W 0 c 7 w 3 I 0 O 20"),
    ]
    df = spark.createDataFrame([("f", n, line) for n, line in lines], "file string, line_no long, line string")
    got = [tuple(r) for r in L.command_stages(df, chunk=64).select("timed_at", "command", "line_no", "stage", "duration_s").collect()]
    assert got == [(2 * far, "/bin/recon-all -s a", far, "One lh", 60.0)]
