"""Line-pipeline specs: the built-in ones and those of YAML or JSON files."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from tessera.operators.lines import ACTIONS, Spec

log = logging.getLogger(__name__)


def step(action: str, **params) -> dict:
    return {"action": action, **params}


FILLED = step("keep_lines", pattern="\\S")
LINES = "{{.lines}}"

# fixed values: the pipelines of common commands
BUILT_IN = [
    Spec("bundle-install", [FILLED, step("aggregate", patterns={"installed": "^Installing ", "using": "^Using ", "fetching": "^Fetching ", "complete": "^Bundle complete"}, format="Bundle complete ({{.using}} cached, {{.installed}} installed)")], "bundle", "install"),
    Spec(
        "cargo-test",
        [
            step("remove_lines", pattern="^\\s*(Compiling|Downloading|Downloaded|Updating|Running|Executable)"),
            FILLED,
            step("state_machine", states={"start": {"keep": "^(test |running |test result)", "until": "^failures", "next": "failures"}, "failures": {"keep": ".", "until": "^$", "next": "done"}}),
            step("aggregate", patterns={"pass": "\\.\\.\\. ok$", "fail": "\\.\\.\\. FAILED$", "ignored": "\\.\\.\\. ignored$"}),
            step("format_template", template=LINES),
        ],
        "cargo",
        "test",
    ),
    Spec("git-diff", [FILLED, step("truncate_lines", max=100, ellipsis="..."), step("head", n=30, overflow_msg="... and more files"), step("format_template", template="{{.count}} files changed:\n" + LINES)], "git", "diff", ("--stat", "--name-only", "--name-status"), inject={"args": ["--stat"], "skip_if_present": ["--stat", "--name-only", "--name-status"]}),
    Spec("git-log", [FILLED, step("truncate_lines", max=80, ellipsis="..."), step("format_template", template="{{.count}} commits:\n" + LINES)], "git", "log", ("--format", "--pretty", "--graph", "--oneline"), inject={"args": ["--pretty=format:%h %s (%ar) <%an>", "--no-merges"], "defaults": {"-n": "10"}, "skip_if_present": ["--merges", "--format", "--pretty", "--oneline"]}),
    Spec("git-status", [FILLED, step("group_by", pattern="^(.{2})", format="{{.Key}} ({{.Count}} files)"), step("format_template", template="{{.count}} changes:\n" + LINES)], "git", "status", ("--porcelain", "--short", "-s"), inject={"args": ["--porcelain"], "skip_if_present": ["--porcelain", "--short", "-s"]}),
    Spec("go-test", [FILLED, step("keep_lines", pattern='"Test":"'), step("keep_lines", pattern='"Action":"(pass|fail)"'), step("aggregate", patterns={"passed": '"Action":"pass"', "failed": '"Action":"fail"'}, format="{{if and (eq .passed 0) (eq .failed 0)}}No tests found{{else}}{{.passed}} passed, {{.failed}} failed{{end}}")], "go", "test", inject={"args": ["-json"], "skip_if_present": ["-json"]}),
    Spec("rails-migrate", [FILLED, step("remove_lines", pattern="^\\s*(-|->)"), step("keep_lines", pattern="migrated"), step("regex_extract", pattern="== \\d+ (\\w+): migrated", format="- $1"), step("aggregate", patterns={"migrated": "^-"}), step("format_template", template="{{with .stats}}{{.migrated}} migrations executed:{{end}}\n" + LINES)], "rails", "db:migrate"),
    Spec("rails-routes", [FILLED, step("remove_lines", pattern="^\\s*Prefix"), step("aggregate", patterns={"routes": "(GET|POST|PUT|PATCH|DELETE)"}), step("head", n=15), step("format_template", template="{{with .stats}}{{.routes}} routes total{{end}} (showing first 15):\n" + LINES)], "rails", "routes", ("-g", "--grep", "-c", "--controller")),
    Spec("rspec", [FILLED, step("keep_lines", pattern="(^\\d+ examples|^rspec \\./)"), step("head", n=10)], "rspec", "", ("--format", "-f")),
    Spec("snr-default", [step("strip_ansi"), step("snr_dedup"), step("head_tail", params={"head": 20, "tail": 20})], "*"),
]


def from_dict(d: dict) -> Spec:
    """A checked spec; a step without a known action is an error."""
    pipeline = d.get("pipeline")
    if not d.get("name") or not isinstance(pipeline, list) or not pipeline:
        raise ValueError("a spec needs a name and a pipeline")
    for s in pipeline:
        if not isinstance(s, dict) or s.get("action") not in ACTIONS:
            raise ValueError(f"unknown action in {d['name']!r}: {s!r}")
    match = d.get("match") or {}
    return Spec(d["name"], pipeline, match.get("command", ""), match.get("subcommand", ""), tuple(match.get("exclude_flags") or ()), tuple(match.get("require_flags") or ()), d.get("inject") or {}, d.get("on_error", "passthrough"))


def parse(text: str) -> dict:
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text)


def load(folder: str | None = None) -> list[Spec]:
    """Built-in specs, those of a folder in place of built-in ones of their name; files in error are passed over."""
    found = {s.name: s for s in BUILT_IN}
    for p in sorted(Path(folder).glob("*")) if folder else []:
        if p.suffix in (".yaml", ".yml", ".json"):
            try:
                spec = from_dict(parse(p.read_text()))
            except (ValueError, OSError, AttributeError) as e:
                log.warning("spec %s was passed over: %s", p, e)
                continue
            found[spec.name] = spec
    return list(found.values())
