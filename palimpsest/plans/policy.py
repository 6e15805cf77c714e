"""Policies: literals, regular expressions and presets, compiled into ordered rules and checked before any job starts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from palimpsest.plans import regex

DEFAULT_REPLACEMENT = "[REDACTED]"

# The presets' names, patterns, labels and validators.
PRESETS = {
    "email": (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]", None),
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", "[IPV4]", None),
    "ipv6": (r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "[IPV6]", None),
    "credit_card": (r"\b\d(?:[ -]?\d){12,18}\b", "[CARD]", "luhn"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]", None),
    "aws_key": (r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}\b", "[AWS_KEY]", None),
    "jwt": (r"\beyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[JWT]", None),
    "phone_us": (r"\b(?:\+?1[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}\b", "[PHONE]", None),
    "windows_account": (r"\b[A-Za-z][A-Za-z0-9.\-]{0,61}\\[A-Za-z0-9._$\-]+", "[ACCOUNT]", None),
    "upn": (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[UPN]", None),
    "fqdn": (r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b", "[FQDN]", "not_file_name"),
    "hostname": (r"\b[A-Za-z][A-Za-z0-9\-]{1,62}\b", "[HOST]", "looks_like_hostname"),
}

# Last labels that make a dotted name a file name.
FILE_ENDINGS = (
    "go json log txt md yaml yml conf cfg ini xml csv png jpg jpeg gif svg pdf zip tar gz tgz bz2 xz 7z rar exe "
    "dll so sh ps1 bat py js ts html htm css sql bak tmp old"
).split()

LITERAL_KEYS = ("value", "pattern", "replacement", "case_insensitive", "whole_word")
POLICY_KEYS = ("default_replacement", "literals", "regex", "presets")


class PolicyError(ValueError):
    """A policy that can't be used; raised before anything is read."""


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    replacement: str
    validator: str | None = None

    @property
    def kind(self) -> str:
        return self.id.partition(":")[0]

    @property
    def text(self) -> str:
        return self.id.partition(":")[2]


def as_rules(config: dict) -> tuple[str, list[Rule]]:
    """The default replacement and the rules, in the order literals, regex, presets."""
    rules: list[Rule] = []
    default = config.get("default_replacement") or DEFAULT_REPLACEMENT
    for kind, key in (("literal", "literals"), ("regex", "regex")):
        for i, item in enumerate(config.get(key) or ()):
            own = item.get("value" if kind == "literal" else "pattern") or ""
            if not own:
                raise PolicyError(f"{key}[{i}]: empty {'value' if kind == 'literal' else 'pattern'}")
            pattern = regex.quoted(own) if kind == "literal" else own
            if item.get("whole_word"):
                pattern = rf"\b{pattern}\b" if kind == "literal" else rf"\b(?:{pattern})\b"
            if item.get("case_insensitive"):
                pattern = f"(?i:{pattern})"
            rules.append(Rule(f"{kind}:{own}", pattern, item.get("replacement") or ""))
    for name in config.get("presets") or ():
        if name not in PRESETS:
            raise PolicyError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
        pattern, label, validator = PRESETS[name]
        rules.append(Rule(f"preset:{name}", pattern, label, validator))
    return default, rules


@dataclass(frozen=True)
class Policy:
    """Rules that have been checked. replacement "" of a rule means the default."""

    rules: tuple[Rule, ...]
    default: str = DEFAULT_REPLACEMENT

    @classmethod
    def of(cls, rules: Iterable[Rule], default: str = "") -> Policy:
        policy = cls(tuple(rules), default or DEFAULT_REPLACEMENT)
        if not policy.rules:
            raise PolicyError("a policy needs at least one rule")
        for r in policy.rules:
            try:
                regex.parse(r.pattern)
            except regex.PatternError as e:
                raise PolicyError(f"rule {r.id!r}: {e}") from None
        policy.check_convergence()
        return policy

    @classmethod
    def parse(cls, raw: str | bytes) -> Policy:
        """A policy from JSON; unknown keys are an error, whatever follows the first value is not read."""
        try:
            text = raw.decode() if isinstance(raw, bytes) else raw
            config, _ = json.JSONDecoder().raw_decode(text.lstrip())
        except ValueError as e:
            raise PolicyError(f"policy is no JSON: {e}") from None
        if not isinstance(config, dict):
            raise PolicyError("policy is no JSON object")
        config = known(config, POLICY_KEYS, "policy")
        for key in ("literals", "regex"):
            config[key] = [known(x, LITERAL_KEYS, key) for x in config.get(key) or ()]
        default, rules = as_rules(config)
        return cls.of(rules, default)

    @classmethod
    def load(cls, path: str) -> Policy:
        return cls.parse(Path(path).read_bytes())

    @classmethod
    def presets(cls, *names: str) -> Policy:
        return cls.parse(json.dumps({"presets": names}))

    def replacement(self, rule: Rule) -> str:
        return rule.replacement or self.default

    @property
    def combined(self) -> str:
        return "|".join(f"(?:{r.pattern})" for r in self.rules)

    @cached_property
    def trees(self) -> list[regex.Node]:
        return [regex.parse(r.pattern) for r in self.rules]

    @property
    def may_match_empty(self) -> bool:
        return any(map(regex.may_be_empty, self.trees))

    def needed(self) -> regex.Need | None:
        """What a text holds if any rule matches in it; None if nothing is certain."""
        sets = [regex.needed(t) for t in self.trees]
        if None in sets:
            return None
        out = sets[0]
        for x in sets[1:]:
            out = out | x
        return out

    def info(self) -> list[tuple[str, str, str]]:
        """(kind, text, label) of each rule."""
        return [(r.kind, r.text, self.replacement(r)) for r in self.rules]

    def check_convergence(self) -> None:
        """No rule may match in what a rule puts in: a second run would change the text again."""
        from palimpsest.functions.matching import Matcher

        m = Matcher(self)
        for label in dict.fromkeys(map(self.replacement, self.rules)):
            if found := m.scrub(label)[1]:
                raise PolicyError(f"replacement {label!r} is itself matched by rule {found[0].rule!r}")


def known(item: object, keys: tuple[str, ...], where: str) -> dict:
    """The object with its keys in lower case; an unknown key is an error."""
    if not isinstance(item, dict):
        raise PolicyError(f"{where}: not an object")
    out = {}
    for k, v in item.items():
        if k.lower() not in keys:
            raise PolicyError(f"{where}: unknown field {k!r}")
        want = bool if k.lower() in ("case_insensitive", "whole_word") else list if k.lower() in ("literals", "regex", "presets") else str
        if v is not None and not isinstance(v, want):
            raise PolicyError(f"{where}: field {k!r} has the wrong type")
        out[k.lower()] = v
    return out


class Registry:
    """Named policies, the default's name, and which key prefix has which policy. A reload that fails leaves all as it was."""

    def __init__(self, policies: dict[str, Policy], default: str, prefixes: dict[str, str] | None = None) -> None:
        self.policies, self.default, self.prefixes = dict(policies), default, dict(prefixes or {})

    @classmethod
    def load(cls, folder: str, default: str = "default", prefixes: dict[str, str] | None = None) -> Registry:
        out = cls({}, default, prefixes)
        out.reload(folder)
        return out

    def reload(self, folder: str) -> None:
        paths = sorted(p for p in Path(folder).iterdir() if p.suffix == ".json" and p.is_file())
        if not paths:
            raise PolicyError(f"no policy in {folder}")
        fresh = {p.stem: Policy.load(str(p)) for p in paths}
        if self.default not in fresh:
            raise PolicyError(f"default policy {self.default!r} is not in {folder}")
        if missing := sorted({n for n in self.prefixes.values() if n not in fresh}):
            raise PolicyError(f"prefixes name unknown policies: {', '.join(missing)}")
        self.policies = fresh

    def set(self, name: str, raw: str | bytes) -> None:
        self.policies = self.policies | {name: Policy.parse(raw)}

    def names(self) -> list[str]:
        return sorted(self.policies)

    def name_for(self, key: str, override: str = "") -> str:
        """The override if it names a policy, else that of the longest prefix, else the default."""
        if override and override in self.policies:
            return override
        best = max((p for p in self.prefixes if key.startswith(p)), key=len, default=None)
        return self.prefixes[best] if best is not None and self.prefixes[best] in self.policies else self.default


def parse_prefixes(raw: str) -> dict[str, str]:
    """{"prefix": "policy", ...} as JSON; empty means none."""
    if not raw.strip():
        return {}
    out = json.loads(raw)
    if not isinstance(out, dict) or not all(isinstance(v, str) for v in out.values()):
        raise PolicyError("prefixes must be an object of strings")
    return out


def stem(path: str) -> str:
    return re.sub(r"\.json$", "", os.path.basename(path))
