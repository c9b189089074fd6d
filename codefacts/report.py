"""Findings as text: by file, each with heading, subject, summary and evidence path."""

from __future__ import annotations

from collections.abc import Iterable

from codefacts.findings import HEADINGS

#: Terminal styles by what they are for.
STYLES = {"bold": "1", "dimmed": "2", "italic": "3", "underline": "4", "cyan": "36", "white": "37", "bright_red": "91", "bright_yellow": "93", "bright_magenta": "95", "bright_cyan": "96", "bright_white": "97"}
HUES = {"Unreachable": "bright_red", "SingleUseChain": "bright_yellow", "EmptyWrapper": "bright_yellow", "FalseSharing": "bright_magenta", "NearDuplicate": "bright_cyan", "TrampData": "bright_yellow", "TypeClone": "bright_magenta", "UnreachingTest": "bright_red"}
MARK = "←── finding"


def summary(finding) -> str:
    """The sentence that says what was found."""
    subject, path = finding["subject"], [n["label"] for n in finding["evidence"]]
    other = path[1] if len(path) > 1 else None
    match finding["shape"]:
        case "Unreachable":
            is_file = subject == finding["file"] or subject.endswith((".ts", ".tsx", ".js", ".jsx"))
            return f"{'File' if is_file else 'Function'} '{subject}' is not reachable from any entry point."
        case "SingleUseChain":
            return f"Chain of {len(path)} functions with exactly one caller per function."
        case "EmptyWrapper":
            return f"Function '{subject}' only forwards calls to {quoted(other, 'another function')}."
        case "FalseSharing":
            return f"Export '{subject}' is imported only within a single consumer group."
        case "NearDuplicate":
            return f"Function '{subject}' has nearly identical implementation to {quoted(other, 'another function')}."
        case "TrampData":
            if other is None:
                return f"Parameter '{subject}' is forwarded without local use."
            return f"Parameter '{subject}' in '{path[0]}' is forwarded to '{other}' without local use."
        case "TypeClone":
            return f"Type '{subject}' has identical fields and types to {quoted(other, 'another type')} without inheritance."
    if other is None:
        return f"Test imports '{subject}' but makes zero typed calls to it."
    return f"Test '{path[0]}' imports '{other}' but makes zero typed calls to it."


def quoted(name: str | None, without: str) -> str:
    return without if name is None else f"'{name}'"


class Painter:
    def __init__(self, colored: bool) -> None:
        self.colored = colored

    def __call__(self, text: str, *styles: str) -> str:
        return f"\x1b[{';'.join(STYLES[s] for s in styles)}m{text}\x1b[0m" if self.colored and styles else text


def evidence_lines(path: list, paint: Painter) -> Iterable[str]:
    for i, node in enumerate(path):
        label = node["label"]
        if node["is_subject"]:
            yield f"{paint(label, 'bold', 'bright_white')}  {paint(MARK, 'bold', 'bright_red')}"
        else:
            name, bracket, rest = label.partition("(")
            yield name + (paint(bracket + rest, "dimmed") if bracket else "")
        if i + 1 < len(path):
            note = node["annotation"]
            yield f"     {paint('│', 'dimmed')}" + (f"  {paint(note, 'italic', 'bright_cyan')}" if note is not None else "")
            yield f"     {paint('▼', 'dimmed')}"


def report_lines(findings: Iterable, colored: bool = False) -> Iterable[str]:
    """Lines of the report of findings that come in their total order; nothing for none."""
    paint, file = Painter(colored), None
    for f in findings:
        if f["file"] != file:
            if file is not None:
                yield ""
            file = f["file"]
            yield paint(file, "bold", "cyan", "underline")
        yield ""
        yield paint(HEADINGS[f["shape"]], "bold", HUES[f["shape"]])
        place = f"(line {f['line']})"
        yield f"{paint('subject:', 'dimmed')} {paint(f['subject'], 'bold')}  {paint(place, 'dimmed')}"
        yield paint(summary(f), "italic", "white")
        yield from evidence_lines(f["evidence"], paint)


def render(findings: Iterable, colored: bool = False) -> str:
    return "".join(line + "\n" for line in report_lines(findings, colored))
