"""Settings from YAML: a file's values over the defaults, section by section, and what they mean as arguments of the operators."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy

# The settings of the rankings, graphs and checks.
DEFAULTS: dict = {
    "people": {"alpha": 0.8, "beta": 0.2, "gamma": 0.1, "top_k": 10},
    "startups": {"alpha": 1.0, "gamma": 0.1, "top_k": 10, "least_similarity": 0.2},
    "priority": {"years": 0.5, "title": 0.5, "engineering": 0.5, "default_years": 10, "bonus": 1.2},
    "people_graph": {"threshold": 0.15, "department_weight": 0.05},
    "startup_graph": {"threshold": 0.22, "category": 0.571, "description": 0.429},
    "startup_fields": {"company": 0.3, "description": 0.5, "category": 0.2},
    "query": {"validation": True, "keywords": True, "low": 0.25, "weak": 0.35},
}
Settings = Mapping[str, Mapping[str, object]] | None


def load(path: str | None = None) -> dict:
    out = deepcopy(DEFAULTS)
    if path:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading a YAML file needs PyYAML") from error
        with open(path, encoding="utf-8") as f:
            for section, values in (yaml.safe_load(f) or {}).items():
                out[section] = {**out.get(section, {}), **values} if isinstance(values, dict) else values
    return out


def number(value: object, default: float, least: float | None = 0.0) -> float:
    """The value as a number, not below ``least``; the default if it is none."""
    try:
        told = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    if told != told:
        return default
    return told if least is None else max(least, told)


def section(settings: Settings, name: str) -> dict:
    """A section with its defaults; numbers that cannot be read, and sections that are no mapping, take theirs."""
    given = (settings or {}).get(name)
    given = given if isinstance(given, Mapping) else {}
    return {k: (v if not isinstance(given.get(k), bool) else given[k]) if isinstance(v, bool) else number(given.get(k, v), v) for k, v in DEFAULTS[name].items()}


def people(settings: Settings = None) -> dict:
    """alpha, beta, gamma and k of ``match_people``."""
    s = section(settings, "people")
    return {"alpha": s["alpha"], "beta": s["beta"], "gamma": s["gamma"], "k": int(s["top_k"])}


def startups(settings: Settings = None) -> dict:
    """alpha, gamma, k, field weights and the least similarity of a field of ``match_startups``."""
    s = section(settings, "startups")
    return {"alpha": s["alpha"], "gamma": s["gamma"], "k": int(s["top_k"]), "least": s["least_similarity"], "weights": section(settings, "startup_fields")}


def checks(settings: Settings = None) -> dict:
    """Whether and how queries are checked and expanded, for both rankings."""
    s = section(settings, "query")
    return {"validate_query": s["validation"], "use_keywords": s["keywords"], "low": s["low"], "weak": s["weak"]}


def person_graph(settings: Settings = None) -> dict:
    """The threshold of ``person_edges``."""
    return {"threshold": section(settings, "people_graph")["threshold"]}


def departments(settings: Settings = None) -> dict:
    """The weight of ``department_links``."""
    return {"department_weight": section(settings, "people_graph")["department_weight"]}


def startup_graph(settings: Settings = None) -> dict:
    """Threshold and weights of ``startup_edges``."""
    s = section(settings, "startup_graph")
    return {"threshold": s["threshold"], "weights": (s["category"], s["description"])}


def priority(settings: Settings = None) -> dict:
    """Weights, default years and bonus of ``profile.priority``."""
    s = section(settings, "priority")
    return {"weights": (s["years"], s["title"], s["engineering"]), "default_years": int(s["default_years"]), "bonus": s["bonus"]}
