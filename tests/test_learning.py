"""Learning: against a sequential version, round trips, libraries, rules, sources, streams and the command line."""

import json
import random
import re
import time
from datetime import datetime

from logloom.cli import main
from logloom.operators import drain
from logloom.operators.annotator import Asking, ModelAnnotator, without_noise
from logloom.operators.extract import Options
from logloom.operators.match import group_column, match, match_join, statistics
from logloom.operators.rules import build_rules, guide_forms, message_groups, read_answer, usable_mappings
from logloom.operators.semantics import annotated, layout, preset, token_class
from logloom.plans import learn as plans_learn
from logloom.plans.learn import failing_samples, learn, learn_files, rebuild_rules
from logloom.plans.parse import events, parse
from logloom.plans.queries import QUERIES, Reviewer
from logloom.plans.render import LIBRARY, OPTIONS, lines
from logloom.settings import Settings
from logloom.sources import library as L
from logloom.sources.lines import head, not_blank, read_lines, read_stream
from logloom.sources.sinks import as_json, read_json_array, write_json_array
from logloom.streaming.learner import gathered, learner_of
from logloom.streaming.progress import Progress
from logloom.streaming.parse import parse_stream, stream_to_jsonl


def some_lines(n=240, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randrange(4)
        day, clock, ip = r.randint(10, 28), f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"10.0.{r.randint(0, 9)}.{r.randint(0, 9)}"
        out.append(
            [
                f"<{r.randint(1, 99)}>Jun {day} {clock} HOST{r.randint(1, 4)} Security-Auditing: {4600 + r.randint(0, 9)}: handle {i}",
                f"Jun {day} {clock} combo kernel: message {i} from {ip}",
                f'Jun {day} {clock} {ip} DVC_ADDRESS="{ip}" MESSAGE="text {i}" LEVEL="{i}"',
                f"[Sat Jun {day} {clock} 2005] [notice] child {i} done",
            ][k]
        )
    return out


def frame(spark, lines, path="f"):
    return spark.createDataFrame([(v, path, i + 1) for i, v in enumerate(lines)], "value string, path string, line_no long")


def similarity(template, line):
    """Share of the first tokens that agree: equal, or of one typed class."""
    n = min(6, len(template), len(line))
    typed = lambda a, b: "<*>" not in (a, b) and token_class(a) == token_class(b) not in ("<WORD>", "<OTHER>")
    return sum(a == b or typed(a, b) for a, b in zip(template[:n], line[:n], strict=True)) / n


def sequential(lines, threshold=0.8):
    """One pass over all lines with a tree of lists, every template compared."""
    leaves, every = {}, []
    for number, line in enumerate(lines, 1):
        toks = line.split()[:64]
        seps = (re.findall(r"\s+", line.strip())[:63] + [" "] * 64)[: len(toks) - 1]
        leaf = leaves.setdefault(" ".join(token_class(t) for t in toks[:6]), [])
        scored = [similarity(t.tokens, toks) for t in leaf]
        if scored and max(scored) >= threshold:
            t = leaf[scored.index(max(scored))]
            t.seps = seps if len(toks) >= len(t.tokens) else t.seps
            t.tokens, t.count = drain.folded(t.tokens, toks), t.count + 1
        else:
            t = drain.Template(toks, seps, 1, [line], number)
            leaf.append(t)
            every.append(t)
    return every


def test_parallel_learning_equals_one_pass(spark):
    lines = some_lines()
    learned = drain.learn_templates(frame(spark, lines))
    found = learned.orderBy("first_line").collect()
    wanted = sequential(lines)
    assert [(t["first_line"], t["tokens"], t["seps"], t["count"]) for t in found] == [(t.first_line, t.tokens, t.seps, t.count) for t in wanted]
    # Putting templates together in Spark and in a list give the same groups.
    templates = [drain.Template(t["tokens"], t["seps"], t["count"], t["samples"], t["first_line"]) for t in found]
    for provider in (None, preset):
        own = [(t.first_line, t.tokens, t.seps, t.count, t.samples, f) for t, f in drain.collect_groups(drain.regroup(learned, provider))["f"]]
        assert own == [(t.first_line, t.tokens, t.seps, t.count, t.samples, f) for t, f in drain.grouped(templates, provider)] and len(own) < len(found)


def test_templates_that_no_line_can_join_are_forgotten(spark):
    leaf = drain.Leaf(6, literal=False)
    found = [leaf.place(f"<{i % 90}>1 2024-01-01T00:00:{i % 60:02d}Z host{i % 7} {i} - -".split(), i) for i in range(2000)]
    assert found == [i - i % 2 for i in range(2000)] and not leaf.live and not leaf.lists
    # Lines with the text of a wildcard join templates of long before.
    lines = [f"a{i % 3} b, {i} c,{i} d" for i in range(60)] + ["<*> b, 7 <*> d", "a1 b, 8 <*> d", "a2 <*> 9 <*> d"] * 4
    got = drain.learn_templates(frame(spark, lines)).orderBy("first_line").collect()
    assert [(t["first_line"], t["tokens"], t["count"]) for t in got] == [(t.first_line, t.tokens, t.count) for t in sequential(lines)]


def test_each_template_is_read_once_by_grouping(spark):
    learned = drain.learn_templates(frame(spark, some_lines())).localCheckpoint()
    asked = spark.sparkContext.accumulator(0)

    def provider(t):
        asked.add(1)
        return preset(t)

    groups = drain.regroup(learned, provider).collect()
    assert asked.value == learned.count() > len(groups) > 1


def test_learned_patterns_match_their_lines(spark):
    lines = some_lines()
    patterns = learn(frame(spark, lines))
    assert {p.extractor for p in patterns} == {"generic", "kv_parser"} and sum(p.count for p in patterns) <= len(lines)
    assert statistics(match(frame(spark, lines), patterns)).first()["unmatched"] == 0
    for p in patterns:
        assert failing_samples(p, frame(spark, list(p.sample_logs))) == 0
    windows = next(p for p in patterns if p.format == "windows_event")
    assert set(re.compile(windows.regex).groupindex) == {"priority", "timestamp", "hostname", "program", "event_id", "message"} - ({"program"} if "program" not in windows.regex else set())


def test_too_few_lines_give_no_pattern(spark):
    assert learn(frame(spark, some_lines()[:1] * 2)) == []


def test_files_are_learned_apart_and_counts_add_up(spark):
    lines = [f"Jun 9 06:06:2{i} combo kernel: up" for i in range(4)]
    both = frame(spark, lines, "a").union(frame(spark, lines, "b"))
    (p,) = learn(both)
    assert p.count == 8 and p.name == "generic_000"
    (again,) = learn(frame(spark, lines), [p])
    assert again.count == 12 and again.priority == p.priority


def test_layouts_and_annotator():
    assert layout("<29>Jun 19 15:04:51 HOST01 Security-Auditing: 4656:".split()) == {2: "timestamp", 3: "hostname", 4: "program", 5: "event_id"}
    assert layout("Jun 9 06:06:20 combo kernel: x".split()) == {2: "timestamp", 3: "hostname", 4: "program"}
    assert layout("Jun 1 00:04:18 192.0.2.254 A".split()) == {3: "source_ip"}
    assert layout("[10.30 16:49:06] chrome.exe -".split()) == {1: "timestamp", 2: "program"} and layout(["x"]) == {}
    assert preset(drain.Template([], [], samples=["<25>1 2025-06-19T15:04:51Z DVC01 2"])) == {0: "priority", 1: "timestamp", 2: "hostname"}

    class Stub:
        asked = 0

        def header_fields(self, tokens, samples):
            self.asked += 1
            return {0: "hostname", 1: "nonsense", 99: "program"}

    stub = Stub()
    templates = [drain.Template(["a"], [], 20, [f"host{i} x y"]) for i in range(3)] + [drain.Template(["a"], [], 3, ["other one"])]
    provide = annotated(stub, templates)
    assert [provide(t) for t in templates] == [{0: "hostname"}] * 3 + [{}] and stub.asked == 1


def test_libraries(tmp_path):
    path = str(tmp_path / "p.yaml")
    assert L.load_patterns(path) == []
    held = [L.Pattern("b", "^b", priority=20), L.Pattern("a", "^a", priority=10, format="x", count=3)]
    L.save(path, held, "1.1", total=2)
    assert [p.name for p in L.load_patterns(path)] == ["a", "b"]
    with open(path, "a", encoding="utf-8") as f:
        f.write("- {name: bad, regex: '('}\n- {regex: '^x'}\n")
    assert [p.name for p in L.load_patterns(path)] == ["a", "b"]
    assert [(p.name, p.count) for p in L.merge_patterns(held, [L.Pattern("n", "^a", count=4), L.Pattern("n", "^c", format="x", count=9)])] == [("x_000", 9), ("a", 7), ("b", 0)]
    rules = str(tmp_path / "r.yaml")
    L.save(rules, [L.Rule("x", "x", regex="a"), L.Rule("none", "none"), L.Rule("k", "k", extract_method="kv_parse")], "2.1")
    assert [r.name for r in L.load_rules(rules)] == ["x"]
    assert [r.regex for r in L.merge_rules([L.Rule("f", "f", regex="1"), L.Rule("g", "g", regex="2")], [L.Rule("f", "f", regex="3")])] == ["2", "3"]


def test_rules_from_mappings(spark):
    rules = build_rules("p", [{"field_name": "source_port", "keyword": "port", "kind": "port"}, {"field_name": "source_port", "kv_key": "X"}, {"field_name": "user", "token": "用户：", "kind": "username"}, {"field_name": "bare"}])
    assert [(r.field_name, r.regex) for r in rules] == [("source_port", r"\bport[=:\s]+\s*(\d+)"), ("user", r"用户：[:：]?\s*(\S+)")]
    assert re.search(rules[0].regex, "failed from 192.0.2.5 port 22")[1] == "22"
    samples = spark.createDataFrame([('FILE_NAME="a.txt" LEVEL="3"',)], "message string")
    kept = usable_mappings([{"field_name": "severity", "kv_key": "FILE_NAME"}, {"field_name": "severity", "kv_key": "LEVEL"}, {"field_name": "raw_message", "kv_key": "X"}, {"field_name": "u", "token": "t" * 41}], samples)
    assert kept == [{"field_name": "severity", "kv_key": "LEVEL"}]
    assert read_answer('<think>no</think>```json\n{"a": 1}\n```') == {"a": 1} and read_answer("[1]") == {"_format_list": [1]} and read_answer('so: {"b": 2}.') == {"b": 2}


def test_profiles(spark):
    rows = [(f'KEY{i % 6}A="1" USER="x"', "f", i) for i in range(12)] + [("free text here", "f", 20)]
    messages = spark.createDataFrame(rows, "message string, path string, line_no long")
    found = guide_forms(messages).first()
    assert (found["verdict"], found["total_forms"], found["n_line_sigs"], found["free_text_ratio"]) == ("mixed", 7, 7, 0.077)
    groups = message_groups(messages, 3, 1).orderBy("rank").collect()
    assert [g["size"] for g in groups] == [2, 2, 2] and groups[0]["samples"] == ['KEY0A="1" USER="x"']


def test_rebuild_rules(spark):
    lines = some_lines()
    patterns = learn(frame(spark, lines))

    class Stub:
        def field_mappings(self, samples):
            return [{"field_name": "device_ip", "kv_key": "DVC_ADDRESS"}]

    rules = rebuild_rules(frame(spark, lines), patterns, Stub())
    assert {r.type for r in rules} == {p.name for p in patterns} and {r.format for r in rules} == {"src1"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\nthr\xffee\rfour")
    (tmp_path / "b.log").write_bytes(b" x \n")
    (tmp_path / "c.txt").write_bytes(b"no\n")
    lines = read_lines(spark, str(tmp_path), "*.log")
    found = sorted((r["path"][-5:], r["line_no"], r["value"]) for r in lines.collect())
    assert found == [("a.log", 1, "one"), ("a.log", 2, ""), ("a.log", 3, "thr�ee"), ("a.log", 4, "four"), ("b.log", 1, " x ")]
    assert sorted(r["value"] for r in not_blank(lines, 2).collect()) == ["one", "thr�ee", "x"]
    assert head(lines, 1).count() == 2


def test_join_form_agrees(spark):
    lines = frame(spark, some_lines(40))
    patterns = L.by_priority(learn(frame(spark, some_lines())))
    from logloom.functions.regex import translate

    table = spark.createDataFrame([(p.name, translate(p.regex).java, p.priority, i) for i, p in enumerate(patterns)], "name string, java string, priority int, ord int")
    chain = {r["line_no"]: patterns[r["pattern_idx"]].name for r in match(lines, patterns).collect()}
    assert {r["line_no"]: r["pattern_name"] for r in match_join(lines, table).collect()} == chain


def test_stream(spark, tmp_path):
    lines = some_lines(60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([*lines, "no header"]) + "\n")
    patterns = learn(frame(spark, lines))
    path = str(tmp_path / "p.yaml")
    L.save(path, patterns, "1.1")
    left = []
    q = stream_to_jsonl(read_stream(spark, str(tmp_path / "in")), path, str(tmp_path / "out"), str(tmp_path / "cp"), errors=str(tmp_path / "err"), options=Options(reference_year=2024), after=lambda df, n: left.append(df.count())).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 60 and left == [1]
    # Errors of a stream name the line, as those of a batch.
    assert [(r["_meta"]["line_no"], r["raw"]) for r in spark.read.json(str(tmp_path / "err")).collect()] == [(61, "no header")]
    memory = parse_stream(read_stream(spark, str(tmp_path / "in")), patterns, [], Options(reference_year=2024)).select("pattern_name").writeStream.format("memory").queryName("parsed").start()
    memory.processAllAvailable()
    memory.stop()
    assert spark.table("parsed").where("pattern_name IS NOT NULL").count() == 60


def test_command_line(spark, tmp_path, capsys):
    log, library = tmp_path / "x.log", str(tmp_path / "lib.yaml")
    log.write_text("\n".join([*some_lines(80), "stray"]) + "\n")
    assert main(["learn", str(log), "--output", library], spark) == 0
    assert main(["transform", "-i", str(log), "-o", str(tmp_path / "o"), "-e", str(tmp_path / "e"), "-p", library, "--year", "2024", "--progress"], spark) == 0
    assert spark.read.text(str(tmp_path / "o")).count() == 80
    assert json.loads(spark.read.text(str(tmp_path / "e")).first()[0]) == {"_meta": {"reason": "no_pattern_matched", "line_no": 81}, "raw": "stray"}
    assert main(["transform", "-i", str(log), "-o", str(tmp_path / "a.json"), "-p", library, "--year", "2024", "--array"], spark) == 0
    assert len(json.loads((tmp_path / "a.json").read_text())) == 80
    said = capsys.readouterr().out
    assert "81 lines, 80 matched, 1 unmatched" in said and "lines/s" in said and "x.log: " in said and "stays as it is" in said


def stub_annotator():
    class Stub:
        def header_fields(self, tokens, samples):
            return {}

        def field_mappings(self, samples):
            return [{"field_name": "device_ip", "kv_key": "DVC_ADDRESS"}]

    return Stub()


def test_command_line_rules_and_missing_files(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text("\n".join(some_lines(80)) + "\n")
    library, rules = str(tmp_path / "lib.yaml"), str(tmp_path / "rules.yaml")
    args = [str(tmp_path / "missing.log"), "--dir", str(tmp_path), "--stage2", rules, "--annotator", f"{__name__}:stub_annotator"]
    assert main(["learn", *args, "--output", library], spark) == 0
    assert {r.field_name for r in L.load_rules(rules)} == {"device_ip"} and "patterns, 1 rules" in capsys.readouterr().out
    assert main(["rebuild", *args, "-p", library, "--replace"], spark) == 0 and len(L.load_rules(rules)) > 0
    assert main(["rebuild", *args, "-p", library, "--no-llm"], spark) == 0 and "stays as it is" in capsys.readouterr().out
    assert read_lines(spark, str(tmp_path / "missing.log")).count() == 0
    assert learn_files(spark, [str(tmp_path / "missing.log")], library) == []


def test_files_that_fail_are_skipped(spark, tmp_path, monkeypatch):
    for name in ("good", "bad"):
        (tmp_path / f"{name}.log").write_text("\n".join(some_lines(80)) + "\n")
    own = plans_learn.learn_with_report

    def failing(lines, *a, **k):
        if any("bad.log" in r["path"] for r in lines.select("path").distinct().collect()):
            raise ValueError("bad file")
        return own(lines, *a, **k)

    monkeypatch.setattr(plans_learn, "learn_with_report", failing)
    library = str(tmp_path / "lib.yaml")
    report = learn_files(spark, [str(tmp_path / "bad.log"), str(tmp_path / "good.log")], library)
    assert [r.get("failed") for r in report] == ["bad file", None] and report[1]["patterns"] == len(L.load_patterns(library)) > 0


def test_settings(tmp_path):
    path = tmp_path / "env"
    path.write_text("# own\nLOGLOOM_TZ='UTC'\nLOGLOOM_RETRIES=5\nLOGLOOM_ANNOTATOR_ENABLED=no\nOTHER=1\n")
    found = Settings.read(str(path), {"LOGLOOM_RETRIES": "7", "LOGLOOM_COVERAGE": "0.5"})
    assert (found.tz, found.retries, found.annotator_enabled, found.coverage, found.rules) == ("UTC", 7, False, 0.5, "stage2_patterns.yaml")
    assert Settings.read(str(tmp_path / "none"), {}) == Settings()


class Client:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def ask(self, prompt, system):
        self.asked.append(prompt)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def asking(*answers, **options):
    slept = []
    return Asking(Client(*answers), sleep=slept.append, clock=lambda: 0.0, **options), slept


def test_questions_are_asked_again_and_apart():
    ask, slept = asking("", ValueError("down"), 'so {"a": 1}')
    assert ask.json("q") == {"a": 1} and slept == [5, 5, 10, 5] and len(ask.client.asked) == 3
    ask, _ = asking("no", "no", "no")
    assert ask.json("q") is None
    ask, _ = asking(enabled=False)
    assert ask.json("q") is None and ask.client.asked == []


def test_answers_are_checked():
    ask, _ = asking('{"fields": [{"position": 1, "field_name": "hostname"}, {"position": 9, "field_name": "program"}, {"position": true, "field_name": "program"}, {"position": 0, "field_name": "odd"}, 3]}')
    assert ModelAnnotator(ask).header_fields(["a", "b"], ["a b"]) == {1: "hostname"}
    ask, _ = asking('[{"field_name": "user", "keyword": "by", "kind": "username", "x": 1}, {"field_name": "raw_message", "kv_key": "X"}, {"field_name": "bare", "kind": "ip"}, {"kv_key": "Y"}]')
    assert ModelAnnotator(ask, forwarded=True).field_mappings(["by me"]) == [{"field_name": "user", "keyword": "by", "kind": "username"}] and "forwarded" in ask.client.asked[0]
    patterns = [L.Pattern("a", "^a", count=1, sample="x"), L.Pattern("b", "^b", count=9)]
    ask, _ = asking('{"noise_names": ["a", "other"], "forwarded": true}', '{"noise_names": ["a"]}', "", "")
    assert ModelAnnotator(ask).check_templates(patterns) == (["a"], True) and [p.name for p in without_noise(patterns, ModelAnnotator(ask))] == ["b"]
    assert ModelAnnotator(ask).check_templates(patterns) == ([], False) and ModelAnnotator(ask).check_templates([]) == ([], False)


def test_all_templates_are_reviewed():
    """More than one question shows, number 999 among them, a sample with a line separator, samples longer than a question has room for."""
    patterns = [L.Pattern(f"fmt_{i:03d}", f"^{i}", count=3 if i < 1050 else 2, sample="a\u2028b\n" if i % 7 else "x" * 2000) for i in range(1100)]
    assert without_noise(patterns, ModelAnnotator(Asking(Reviewer(), cooldown=0))) == patterns[:1050]
    patterns = [L.Pattern(f"p{i}", f"^{i}", count=1, sample=f"{i}" + "y" * n + "end") for i, n in enumerate([1] * 41 + [7000, 7000, 20_000])]
    ask, _ = asking('{"noise_names": ["p0", "p40"]}', "", "", '{"noise_names": ["p42", "p0"], "forwarded": true}', '{"noise_names": ["p43"], "forwarded": false}')
    assert ModelAnnotator(ask).check_templates(patterns) == (["p0", "p42", "p43"], True)
    shown = [json.loads(line) for i in (0, 1, 3, 4) for line in ask.client.asked[i].split("\n") if line.startswith('{"name"')]
    assert [(x["name"], x["sample"]) for x in shown] == [(p.name, p.sample) for p in patterns] and len(ask.client.asked) == 5


def test_reviewed_patterns_of_many_forms(spark, tmp_path):
    """60 forms in one file, each of two to four lines: those of two are noise, wherever they stand."""
    names = ["noise" + "".join("abcdefghij"[int(d)] for d in f"{i:02d}") for i in range(60)]
    types = [name for i, name in enumerate(names) for _ in range(i % 3 + 2)]
    rows = [(4 * i + 3, datetime(2024, 6, 1), i, name) for i, name in enumerate(types)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["reviewed_patterns"](spark, str(tmp_path)).collect()
    assert sorted((r["regex"], r["count"]) for r in found) == [(rf"^{name}\ without\ a\ header\ \d+$", i % 3 + 2) for i, name in enumerate(names) if i % 3]


def test_large_libraries_are_planned_quickly(spark):
    patterns = [L.Pattern(f"p{i}", rf"^<(?P<priority>\d+)>kind{i} (?P<hostname>\S+) (?P<message>.+)$", priority=i) for i in range(2000)]
    lines = frame(spark, ["<13>kind1999 host one message", "<14>kind0 other two", "none", "<15>kind7 h \ue000\ue001 x"])
    began = time.monotonic()
    found = match(lines, patterns).select("line_no", "pattern_idx", group_column(patterns, "hostname").alias("h"), group_column(patterns, "message").alias("m")).collect()
    assert [tuple(r) for r in sorted(found)] == [(1, 1999, "host", "one message"), (2, 0, "other", "two"), (3, None, None, None), (4, 7, "h", "\ue000\ue001 x")]
    print(f"planned and run in {time.monotonic() - began:.1f} s")


def test_stream_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    progress = Progress()
    spark.streams.addListener(progress)
    q = read_stream(spark, str(tmp_path / "in")).select("value", "path").writeStream.format("memory").queryName("progressed").start()
    q.processAllAvailable()
    q.stop()
    for _ in range(50):
        if progress.lines == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.lines == 2 and spark.table("progressed").first()["path"].endswith("a.log")


def heads_of(lines, threshold):
    """For each line the number of its template's first line, by the index over heads."""
    leaves, out = {}, []
    for number, line in enumerate(lines, 1):
        head = line.split()[:6]
        leaf = leaves.setdefault(" ".join(token_class(t) for t in head), drain.Leaf(len(head), threshold))
        out.append(leaf.place(head, number))
    return out


def test_index_of_heads_equals_comparing_all():
    """Few words, so that templates compete; the text of a wildcard in lines; all thresholds."""
    r = random.Random(7)
    for trial in range(150):
        threshold = r.choice([0.8, 0.8, 0.5, 0.6, 0.34, 1.0])
        words = ["a", "b", "c", "x,", "12", "7", "10.0.0.1"] + ["<*>"] * (trial % 3)
        lines = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 5, 6, 8]))) for _ in range(60)]
        counts = {t.first_line: t.count for t in sequential(lines, threshold)}
        found = heads_of(lines, threshold)
        assert {n: found.count(n) for n in set(found)} == counts


def test_learning_takes_time_linear_in_templates():
    """64,000 lines of one path, none like another."""
    lines = [f"a{i} b{i} c{i} d{i} e{i} f{i}." .replace("0", "o").replace("1", "l") for i in range(64_000)]
    began = time.monotonic()
    assert len(set(heads_of([x.translate(str.maketrans("23456789", "zeasgtbq")) for x in lines], 0.8))) == 64_000
    assert time.monotonic() - began < 60


def test_learning_counts_places_tails_and_odd_lines(spark):
    r = random.Random(9)
    lines = [f"app started worker unit number {r.choice('abc')} tail {' '.join(r.choice('xyz') for _ in range(r.randint(0, 70)))}".strip() for _ in range(300)] + ["<*> b c d e f"] * 3 + ["one", "", "  ", "one  two", "one\ttwo three"]
    found = drain.learn_templates(frame(spark, [x for x in lines]).union(spark.createDataFrame([(None, "f", 9999)], "value string, path string, line_no long"))).orderBy("first_line").collect()
    kept = [(i, x) for i, x in enumerate(lines, 1) if x.strip()]
    wanted = sequential([x for _, x in kept])
    numbers = dict(enumerate((i for i, _ in kept), 1))
    assert [(t["first_line"], t["tokens"], t["seps"], t["count"]) for t in found] == [(numbers[t.first_line], t.tokens, t.seps, t.count) for t in wanted]
    big = max(found, key=lambda t: t["count"])
    assert len(big["samples"]) == 50 and big["samples"] == lines[:300][:50] if big["count"] == 300 else True
    assert drain.learn_templates(frame(spark, ["x"]).limit(0)).count() == 0


def test_libraries_as_tables_equal_lists(spark):
    r = random.Random(12)
    for _ in range(3):
        held = [L.Pattern(r.choice(["generic_{:03d}", "huawei_{:03d}", "own"]).format(i), f"^{i}", priority=r.randint(1, 3), format=r.choice(["generic", "huawei"]), count=r.randint(0, 5), sample_logs=tuple(r.sample("abcd", 2))) for i in range(8)]
        new = [L.Pattern(f"fmt_{i:03d}", f"^{r.randint(0, 5) if i < 2 else i + 20}{'x' * i}", priority=90, format=r.choice(["generic", "", "other"]), count=r.randint(1, 5)) for i in range(7)]
        merged = L.merge_frames(L.to_frame(spark, held), L.to_frame(spark, new)).orderBy("ord").collect()
        assert [(m["regex"], m["name"], m["format"], m["priority"], m["count"]) for m in merged] == [(p.regex, p.name, p.format, p.priority, p.count) for p in L.merge_patterns(held, new)]
        one = L.Pattern(held[3].name, "^new", priority=2, sample_logs=("d", "e"))
        held = list({p.name: p for p in held}.values())
        put = L.upsert_frames(L.to_frame(spark, L.by_priority(held)), L.to_frame(spark, [one])).orderBy("ord").collect()
        assert [(m["name"], m["regex"], tuple(m["sample_logs"])) for m in put] == [(p.name, p.regex, p.sample_logs) for p in L.add_pattern(L.by_priority(held), one)]


def test_stream_calls_the_learner_when_there_are_enough_lines_or_no_more(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "p.yaml")
    lines = [f"Jun {10 + i % 9} 06:06:{10 + i % 50} combo kernel: message {i}" for i in range(57)]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n")
    groups = gathered(read_stream(spark, str(tmp_path / "in")), 50, 0.5)
    def called(df, number):
        for r in df.collect():
            found.append((r["reason"], r["first"], list(r["lines"])))
            offered.append(number)
        learn_batch(df, number)

    found, offered = [], []
    learn_batch = learner_of(path)
    query = groups.writeStream.foreachBatch(called).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    # Timers keep such a query busy, so it is not waited for to be idle.
    for _ in range(120):
        if len(found) == 2:
            break
        time.sleep(0.5)
    query.stop()
    assert [(reason, first, len(own)) for reason, first, own in found] == [("enough", 0, 50), ("idle", 50, 7)] and len(set(offered)) == 2
    assert found[0][2] + found[1][2] == lines
    assert statistics(match(frame(spark, lines), L.load_patterns(path))).first()["unmatched"] == 0


def test_json_array_of_many_parts(spark, tmp_path):
    rows = [(i, f"ü {i}", None if i % 2 else "x") for i in range(50)]
    events = spark.createDataFrame(rows, "n int, text string, odd string").repartition(7).sortWithinPartitions("n")
    write_json_array(events, str(tmp_path / "a.json"))
    text = (tmp_path / "a.json").read_text(encoding="utf-8")
    assert json.loads(text) == [json.loads(r["value"]) for r in as_json(events).collect()] and len(json.loads(text)) == 50
    assert text.startswith("[\n{\n  \"n\": ") and "ü" in text and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.json"]
    write_json_array(events.limit(0), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == []


def test_json_array_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 28), i % 9, ("click", "view\n}", "a},{ [b]")[i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = QUERIES["json_array_sink"](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 10
        wanted = events(parse(lines(spark, str(tmp_path)), LIBRARY, [], OPTIONS)).select("parsed_content.syslog", "priority", "hostname").collect()
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, wanted))) and len(wanted) > 100
        # Events without any field, and braces at the beginning of a line of a text.
        write_json_array(spark.createDataFrame([(None,), ("x\n}",), (None,), ("{",)], "a string"), str(tmp_path / "a.json"))
        assert sorted(str(r["a"]) for r in read_json_array(spark, str(tmp_path / "a.json"), "a string").collect()) == ["None", "None", "x\n}", "{"]
        assert len(json.loads((tmp_path / "a.json").read_text())) == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rebuild_over_many_files_runs_the_same_jobs(spark):
    """Stable and mixed files, one without patterns, keys without numbers; jobs do not grow with the files."""
    win = L.Pattern("win", r"^<(?P<priority>\d+)>\S+\ \d+\ (?P<timestamp>\S+)\ (?P<hostname>\S+)\ (?P<message>.+)$")
    other = L.Pattern("other", r"^app\ (?P<message>.+)$")
    slow = L.Pattern("slow", r"^(?P<a>q)?(?(a)x|zz) (?P<message>.+)$")
    files = {
        "a": [f'<1>Jun 1 10:00:0{i} h LEVEL="3" NAME="x"' for i in range(9)],
        "b": ["no pattern here"] * 3,
        "c": [f'app {w} {w}{i} NAME="n{i}"' for i, w in enumerate("abcdefghijkl")] + [f'app K{i}="1" L{i}="2"' for i in range(9)],
        "d": ["zz one two"] + ["app late"] * 2,
    }

    class Stub:
        asked = []

        def field_mappings(self, samples):
            self.asked.append(samples)
            return [{"field_name": "severity", "kv_key": "LEVEL"}, {"field_name": "user", "kv_key": "NAME"}]

    def lines_of(some):
        return spark.createDataFrame([(v, p, i + 1) for p, own in some.items() for i, v in enumerate(own)], "value string, path string, line_no long")

    rules, report = plans_learn.rebuild_with_report(lines_of(files), [win, other, slow], Stub())
    assert report == [{"path": "a", "patterns": 1, "rules": 2}, {"path": "b", "patterns": 0, "rules": 0}, {"path": "c", "patterns": 1, "rules": 1}, {"path": "d", "patterns": 2, "rules": 1}]
    assert [(r.field_name, r.type, r.format) for r in rules] == [("severity", "win", "src1"), ("user", "win", "src1"), ("user", "other", "src3"), ("user", "other", "src4"), ("user", "slow", "src4")]
    assert Stub.asked[0] == ['LEVEL="3" NAME="x"'] * 6 and ["one two", "late", "late"] in Stub.asked

    def jobs(some):
        tracker, group = spark.sparkContext.statusTracker(), f"rebuild-{len(some)}"
        spark.sparkContext.setJobGroup(group, "")
        plans_learn.rebuild_with_report(lines_of(some), [win, other, slow], Stub())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs({f"{p}{k}": own for p, own in files.items() for k in range(10)}) <= jobs(files) + 4
