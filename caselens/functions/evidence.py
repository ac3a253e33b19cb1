"""Verbatim evidence: quotes that a model proposes become spans of the source, spans are realigned, shifted and merged, and events are
rendered as retrieval views. All of it depends on the order within one document, so it is plain Python for one Arrow UDF a document.

An event is a dict: normalized_event_type, trigger, actors, objects, behaviors, impacts, requests, time_expressions (lists of spans),
locations (list of {evidence, kind, normalized_name}), search_terms, polarity. A span is {text, start, end}; a quote has text only."""

from __future__ import annotations

from collections.abc import Iterable

SPAN_FIELDS = ("actors", "objects", "behaviors", "impacts", "requests", "time_expressions")
# The order in which quotes stand in for a trigger, limits of merged events, hedging words, labels of the views.
STAND_INS = ("behaviors", "objects", "impacts", "requests", "locations", "time_expressions", "actors")
LIMITS = {"actors": 4, "objects": 5, "behaviors": 5, "impacts": 4, "requests": 4, "locations": 5, "time_expressions": 4, "search_terms": 8}
MAX_EVENTS = 3
HEDGES = ("疑似", "涉嫌", "可能")
VIEW_LABELS = {"trigger": "原文触发", "actors": "主体", "objects": "对象", "behaviors": "行为现象", "impacts": "影响"}


class EvidenceError(ValueError):
    """code says what is wrong; counts what was seen until then."""

    def __init__(self, code: str, **counts: int):
        super().__init__(code)
        self.code, self.counts = code, counts


def places(source: str, needle: str) -> list[int]:
    out, at = [], source.find(needle)
    while at >= 0:
        out.append(at)
        at = source.find(needle, at + 1)
    return out


def _span(text: str, start: int) -> dict:
    return {"text": text, "start": start, "end": start + len(text)}


def _distinct(items: Iterable, key=lambda x: x) -> list:
    seen: dict = {}
    for x in items:
        seen.setdefault(key(x), x)
    return list(seen.values())


def _span_key(s: dict) -> tuple:
    return s["start"], s["end"], s["text"]


class Grounder:
    """Grounds the events of one document and counts on the way."""

    def __init__(self, source: str):
        self.source, self.used = source, {}
        self.counts = dict.fromkeys(("proposed_evidence_quotes", "rejected_evidence_quotes", "ambiguous_matches", "trigger_fallbacks", "dropped_events", "polarity_repairs"), 0)

    def _quotes(self, event: dict) -> list[str]:
        return [(q["evidence"] if f == "locations" else q)["text"] for f in STAND_INS for q in event.get(f, [])]

    def _trigger(self, text: str) -> dict | None:
        """The first place that no trigger of the same text has taken, else the first of all."""
        found = places(self.source, text)
        if not found:
            return None
        self.counts["ambiguous_matches"] += len(found) > 1
        taken = self.used.setdefault(text, set())
        return _span(text, next((p for p in found if p not in taken), found[0]))

    def _near(self, text: str, anchor: int) -> dict | None:
        found = places(self.source, text)
        if not found:
            self.counts["rejected_evidence_quotes"] += 1
            return None
        self.counts["ambiguous_matches"] += len(found) > 1
        return _span(text, min(found, key=lambda p: (abs(p - anchor), p)))

    def event(self, event: dict) -> dict | None:
        quotes = self._quotes(event)
        self.counts["proposed_evidence_quotes"] += 1 + len(quotes)
        trigger = self._trigger(event["trigger"]["text"])
        if trigger is None:
            self.counts["rejected_evidence_quotes"] += 1
            trigger = next((t for t in map(self._trigger, quotes) if t is not None), None)
            if trigger is None:
                self.counts["rejected_evidence_quotes"] += len(quotes)
                self.counts["dropped_events"] += 1
                return None
            self.counts["trigger_fallbacks"] += 1
        self.used.setdefault(trigger["text"], set()).add(trigger["start"])
        out = {"normalized_event_type": event["normalized_event_type"], "trigger": trigger, "search_terms": _distinct(event.get("search_terms", [])), "polarity": event.get("polarity")}
        for field in SPAN_FIELDS:
            spans = (self._near(q["text"], trigger["start"]) for q in event.get(field, []))
            out[field] = _distinct((s for s in spans if s is not None), _span_key)
        located = ({**x, "evidence": self._near(x["evidence"]["text"], trigger["start"])} for x in event.get("locations", []))
        out["locations"] = _distinct((x for x in located if x["evidence"] is not None), lambda x: (x["evidence"]["start"], x["evidence"]["end"], x["kind"]))
        if out["polarity"] == "occurred" and out["normalized_event_type"].lstrip().startswith(HEDGES):
            out["polarity"] = "possible"
            self.counts["polarity_repairs"] += 1
        return out


def span_count(events: list[dict]) -> int:
    return sum(1 + len(e["locations"]) + sum(len(e[f]) for f in SPAN_FIELDS) for e in events)


def ground(events: list[dict], source: str) -> tuple[list[dict], dict[str, int]]:
    """(grounded events, counts). An error with the counts when there were events and none of them has a quote of the source."""
    grounder = Grounder(source)
    out = [e for e in map(grounder.event, events) if e is not None]
    if events and not out:
        raise EvidenceError("NO_GROUNDED_EVENTS", **grounder.counts)
    return out, grounder.counts | {"grounded_spans": span_count(out)}


def align(span: dict, source: str) -> tuple[dict, bool]:
    """(span at its true place, whether that is a repair): a wrong offset moves to the nearest place of the text, if there is one."""
    if source[span["start"] : span["end"]] == span["text"] and span["end"] <= len(source):
        return span, False
    by_distance = sorted((abs(p - span["start"]), p) for p in places(source, span["text"]))
    if not by_distance:
        raise EvidenceError("EVIDENCE_TEXT_NOT_FOUND")
    if len(by_distance) > 1 and by_distance[0][0] == by_distance[1][0]:
        raise EvidenceError("AMBIGUOUS_EVIDENCE_POSITION")
    return _span(span["text"], by_distance[0][1]), True


def align_events(events: list[dict], source: str) -> tuple[list[dict], int]:
    """(aligned events, number of repaired spans); spans that meet become one."""
    repairs = 0

    def fix(span: dict) -> dict:
        nonlocal repairs
        fixed, repaired = align(span, source)
        repairs += repaired
        return fixed

    out = []
    for e in events:
        fields = {f: _distinct([fix(s) for s in e.get(f, [])], _span_key) for f in SPAN_FIELDS}
        out.append({**e, **fields, "trigger": fix(e["trigger"]), "locations": [{**x, "evidence": fix(x["evidence"])} for x in e.get("locations", [])]})
    return out, repairs


def shift(events: list[dict], by: int) -> list[dict]:
    """Events of a segment with the places of the whole document."""
    move = lambda s: {**s, "start": s["start"] + by, "end": s["end"] + by}
    return [{**e, **{f: [move(s) for s in e.get(f, [])] for f in SPAN_FIELDS}, "trigger": move(e["trigger"]), "locations": [{**x, "evidence": move(x["evidence"])} for x in e.get("locations", [])]} for e in events]


def merge(parts: list[list[dict]]) -> list[dict]:
    """Events of all segments, one for each type and polarity in order of appearance, with limited distinct evidence."""
    groups: dict[tuple, list[dict]] = {}
    for e in (e for part in parts for e in part):
        groups.setdefault((e["normalized_event_type"], e["polarity"]), []).append(e)
    if len(groups) > MAX_EVENTS:
        raise EvidenceError("TOO_MANY_EVENTS")
    out = []
    for (kind, polarity), own in groups.items():
        every = lambda f, own=own: (x for e in own for x in e.get(f, []))
        merged = {f: _distinct(every(f), _span_key)[: LIMITS[f]] for f in SPAN_FIELDS}
        merged["locations"] = _distinct(every("locations"), lambda x: (x["evidence"]["start"], x["evidence"]["end"], x["kind"], x.get("normalized_name")))[: LIMITS["locations"]]
        merged["search_terms"] = _distinct(every("search_terms"))[: LIMITS["search_terms"]]
        trigger = min((e["trigger"] for e in own), key=lambda s: (s["start"], s["end"]))
        out.append({"normalized_event_type": kind, "trigger": trigger, "polarity": polarity, **merged})
    return out


def _line(label: str, values: Iterable[str]) -> list[str]:
    items = _distinct(v.strip() for v in values if v.strip())
    return [f"{label}：{'；'.join(items)}"] if items else []


def views(events: list[dict]) -> dict[str, str]:
    """Five texts of an extraction for retrieval; blocks of events are parted by an empty line."""
    blocks: dict[str, list[str]] = {k: [] for k in ("evidence_core", "semantic_terms", "semantic_core", "semantic_with_request", "semantic_with_location")}
    for e in events:
        texts = lambda f, e=e: [s["text"] for s in e.get(f, [])]
        head = [f"问题：{e['normalized_event_type']}"]
        terms = _line("检索词", e.get("search_terms", []))
        evidence = [x for f, label in VIEW_LABELS.items() for x in _line(label, [e["trigger"]["text"]] if f == "trigger" else texts(f))]
        core = head + evidence + terms
        request = _line("诉求", texts("requests"))
        where = _line("地点", [x.get("normalized_name") or x["evidence"]["text"] for x in e.get("locations", [])])
        lines = {"evidence_core": evidence, "semantic_terms": head + terms, "semantic_core": core, "semantic_with_request": core + request, "semantic_with_location": core + request + where + _line("时间", texts("time_expressions"))}
        for name, own in lines.items():
            blocks[name].append("\n".join(own))
    return {name: "\n\n".join(own) for name, own in blocks.items()}


def event_evidence(event: dict) -> list[str]:
    """The distinct texts that stand for an event, in order of the fields."""
    return _distinct([event["trigger"]["text"], *(s["text"] for f in SPAN_FIELDS for s in event.get(f, [])), *(x["evidence"]["text"] for x in event.get("locations", []))])
