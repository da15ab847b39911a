"""Importer of rule files in the SecRule language: directives to rules, with a report of what was not taken and why."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidegate.plans.model import Action, Op, Rule, Target

#: How names map.
VARIABLES = {
    "ARGS": "ARGS", "ARGS_NAMES": "ARGS_NAMES", "ARGS_GET": "ARGS_GET", "ARGS_GET_NAMES": "ARGS_NAMES", "ARGS_POST": "ARGS_POST", "ARGS_POST_NAMES": "ARGS_NAMES", "QUERY_STRING": "REQUEST_URI",
    "REQUEST_URI": "REQUEST_URI", "REQUEST_URI_RAW": "REQUEST_URI", "REQUEST_FILENAME": "REQUEST_PATH", "REQUEST_BASENAME": "REQUEST_PATH", "REQUEST_LINE": "REQUEST_LINE", "REQUEST_METHOD": "REQUEST_METHOD", "REQUEST_PROTOCOL": "REQUEST_PROTOCOL",
    "REQUEST_HEADERS": "REQUEST_HEADERS", "REQUEST_HEADERS_NAMES": "REQUEST_HEADER_NAMES", "REQUEST_COOKIES": "REQUEST_COOKIES", "REQUEST_COOKIES_NAMES": "REQUEST_COOKIE_NAMES", "REQUEST_BODY": "REQUEST_BODY", "FILES": "FILES_NAMES", "FILES_NAMES": "FILES_NAMES",
    "REMOTE_ADDR": "REMOTE_ADDR", "RESPONSE_STATUS": "RESPONSE_STATUS", "RESPONSE_HEADERS": "RESPONSE_HEADERS", "RESPONSE_HEADERS_NAMES": "RESPONSE_HEADER_NAMES", "RESPONSE_BODY": "RESPONSE_BODY",
}
TRANSFORMS = {"lowercase": "lowercase", "urldecode": "url_decode", "urldecodeuni": "url_decode", "removewhitespace": "remove_whitespace", "compresswhitespace": "compress_whitespace", "normalizepath": "normalize_path", "normalisepath": "normalize_path", "normalizepathwin": "normalize_path", "normalisepathwin": "normalize_path", "jsdecode": "escape_decode", "escapeseqdecode": "escape_decode"}
NO_OPS = frozenset(["trim", "trimleft", "trimright", "removenulls", "utf8tounicode", "htmlentitydecode"])
SEVERITY = {"EMERGENCY": "critical", "ALERT": "critical", "CRITICAL": "critical", "ERROR": "error", "WARNING": "warning", "NOTICE": "notice", "INFO": "notice", "DEBUG": "notice", "0": "critical", "1": "critical", "2": "critical", "3": "error", "4": "warning", "5": "notice", "6": "notice", "7": "notice"}
REFUSED = frozenset("eq gt lt ge le ipMatch ipMatchFromFile ipMatchF geoLookup rbl pmFromFile pmf validateByteRange validateUrlEncoding validateUtf8Encoding validateSchema validateDTD validateHash inspectFile fuzzyHash verifyCC verifyCPF verifySSN unconditionalMatch rsub".split())
GATE_TIER = {1: "high", 2: "medium", 3: "low", 4: "heuristic"}


@dataclass
class Report:
    taken: list[int] = field(default_factory=list)
    skipped: list[tuple[str, int, str]] = field(default_factory=list)

    def skip(self, directive: str, rid: int, why: str) -> None:
        self.skipped.append((directive, rid, why))


class ImportRefused(ValueError):
    """Strict parsing met what it cannot take."""


def logical_lines(text: str) -> list[str]:
    """Lines with continuations joined, without comments and blanks."""
    joined = re.sub(r"\\[ \t]*\r?\n", " ", text)
    return [x.strip() for x in joined.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def words(line: str) -> list[str]:
    """Words of a directive; quotes group, and a backslash keeps a quote inside."""
    out = []
    for m in re.finditer(r'"((?:\\.|[^"\\])*)"|\'((?:\\.|[^\'\\])*)\'|(\S+)', line):
        out.append(m[3] if m[3] is not None else re.sub(r'\\(["\'])', r"\1", m[1] if m[1] is not None else m[2]))
    return out


def actions_of(text: str) -> list[tuple[str, str]]:
    """name:value pairs between commas outside single quotes."""
    parts = re.findall(r"(?:'(?:\\.|[^'\\])*'|[^,'])+", text)
    pairs = (p.strip().partition(":") for p in parts if p.strip())
    return [(n.strip(), v.strip().strip("'")) for n, _, v in pairs]


class Refused(Exception):
    pass


def targets_of(text: str) -> tuple[Target, ...]:
    out = []
    for v in re.findall(r"(?:/(?:\\.|[^/\\])*/|[^|/])+", text):
        v = v.strip()
        if v.startswith("!"):
            raise Refused("excluded variable")
        if v.startswith("&"):
            raise Refused("variable count")
        kind, _, name = v.partition(":")
        if name.startswith("/"):
            raise Refused("regular expression in a variable")
        if kind == "XML":
            out.append(Target("REQUEST_BODY"))
        elif kind in VARIABLES:
            out.append(Target(VARIABLES[kind], name))
        else:
            raise Refused(f"variable {kind}")
    if not out:
        raise Refused("no variable")
    return tuple(dict.fromkeys(out))


def literal_hint(pattern: str) -> tuple[str, ...] | None:
    """Literals of which every match of a pattern holds one, all of three characters or more and lower-cased; None if there are none."""
    import re._parser as parser

    def required(tree) -> set[str] | None:
        best, run = None, ""
        options: list[set[str]] = []
        for code, arg in [*tree, (None, None)]:
            name = str(code)
            if name == "LITERAL" and 0 < arg < 256:
                run += chr(arg).lower() if arg < 128 else chr(arg)
                continue
            if len(run) >= 3:
                options.append({run})
            run = ""
            if name == "SUBPATTERN":
                inner = required(arg[3])
                if inner:
                    options.append(inner)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                inner = required(arg[2])
                if inner:
                    options.append(inner)
            elif name == "BRANCH":
                sides = [required(b) for b in arg[1]]
                if all(sides):
                    options.append(set().union(*sides))
        for o in options:
            if best is None or min(map(len, o)) > min(map(len, best)):
                best = o
        return best

    try:
        found = required(parser.parse(pattern))
    except Exception:  # the pattern is checked where it is used; here it only has no hint
        return None
    return tuple(sorted(found)) if found else None


def operator_of(text: str) -> Op:
    from tidegate.operators.predicates import check_regex

    negated = text.startswith("!")
    text = text[1:] if negated else text
    name, _, arg = (text[1:].partition(" ") if text.startswith("@") else ("rx", "", text))
    arg = arg.strip()
    if name in REFUSED:
        raise Refused(f"operator {name}")
    if negated and name != "rx":
        raise Refused(f"negated {name}")
    regexes = {"containsWord": lambda a: rf"\b{re.escape(a)}\b", "endsWith": lambda a: re.escape(a) + "$"}
    if name == "rx" or name in regexes:
        pattern = arg if name == "rx" else regexes[name](arg)
        try:
            check_regex(pattern)
            re.compile(pattern)
        except (ValueError, re.error) as e:
            raise Refused(f"pattern: {e}") from e
        return Op("rx", (pattern,), negated, None if negated else literal_hint(pattern), 80)
    if name == "contains":
        return Op("contains", (arg,))
    if name == "streq":
        return Op("equals", (arg,))
    if name == "beginsWith":
        return Op("has_prefix", (arg,))
    if name in ("pm", "within"):
        return Op("contains_any", tuple(arg.split()))
    if name in ("detectSQLi", "detectXSS"):
        from tidegate.functions.detectors import GATES

        of = {"detectSQLi": "sqli", "detectXSS": "xss"}[name]
        return Op(f"detect_{of}", (), False, GATES[of]["literals"](()), GATES[of]["cost"])
    raise Refused(f"operator {name}")


def _chain(acts: list[tuple[str, str]]) -> tuple[str, ...]:
    out: list[str] = []
    for n, v in acts:
        if n != "t":
            continue
        low = v.lower()
        if low == "none":
            out.clear()
        elif low in TRANSFORMS:
            out.append(TRANSFORMS[low])
        elif low not in NO_OPS:
            raise Refused(f"transform {v}")
    return tuple(out)


def parse(text: str, strict: bool = False) -> tuple[list[Rule], Report]:
    """Rules of a rule file and the report. ``strict`` raises if anything is skipped."""
    rules: dict[int, Rule] = {}
    report, defaults, tier, in_chain = Report(), {}, "high", False
    removed: list[tuple[int, int]] = []
    for line in logical_lines(text):
        parts = words(line)
        name, args = parts[0], parts[1:]
        if name == "SecDefaultAction" and args:
            acts = actions_of(args[0])
            defaults[dict(acts).get("phase", "2")] = acts
        elif name == "SecMarker":
            tier = "high"
        elif name == "SecRuleRemoveById":
            for a in args:
                lo, _, hi = a.partition("-")
                removed.append((int(lo), int(hi or lo)))
        elif name == "SecRule" and len(args) >= 2:
            acts = actions_of(args[2]) if len(args) > 2 else []
            given = dict(acts)
            rid = int(given.get("id", 0) or 0)
            if (m := re.match(r"@lt ([1-4])\Z", args[1].strip())) and "skipAfter" in given:
                tier = GATE_TIER[int(m[1])]
                continue
            was_chain, in_chain = in_chain, "chain" in given
            if was_chain or in_chain:
                report.skip(name, rid, "chain")
                continue
            phase = {"request": "2", "response": "4", "logging": "5"}.get(given.get("phase", "2"), given.get("phase", "2"))
            merged = [*[a for a in defaults.get(phase, []) if a[0] not in given], *acts]
            names = {n for n, _ in merged}
            try:
                if not rid:
                    raise Refused("no id")
                kind = "block" if names & {"deny", "drop", "redirect", "block"} else "allow" if "allow" in names else "score"
                rules[rid] = Rule(
                    rid, int(phase), targets_of(args[0]), operator_of(args[1]), _chain(acts),
                    (Action(kind, 0, int(given.get("status", 0) or 0)),), SEVERITY.get(given.get("severity", "WARNING").upper(), "warning"), tier,
                    given.get("msg", ""), tuple(v for n, v in acts if n == "tag"),
                )
                report.taken.append(rid)
            except (Refused, ValueError) as e:
                report.skip(name, rid, str(e))
        else:
            report.skip(name, 0, "directive")
    for lo, hi in removed:
        rules = {i: r for i, r in rules.items() if not lo <= i <= hi}
    if strict and report.skipped:
        raise ImportRefused("; ".join(f"{d} {i}: {w}" for d, i, w in report.skipped))
    return list(rules.values()), report


def report_frame(spark, report: Report):
    """The report as a table: directive, rule id, outcome and reason."""
    rows = [("SecRule", i, "taken", "") for i in report.taken] + [(d, i, "skipped", w) for d, i, w in report.skipped]
    return spark.createDataFrame(rows, "directive string, rule_id bigint, outcome string, reason string")
