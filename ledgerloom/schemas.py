"""Declared schemas of the relations, as DDL; nothing is inferred from data."""

from __future__ import annotations

_MODULES = "modules map<string, struct<included: boolean, level: string, note: string>>"
_COVERAGE = (
    "coverage struct<versicherungssumme: string, selbstbeteiligung: string, wartezeit_monate: int, wartezeit_ausnahmen: array<string>, "
    "geltungsbereich: string, vertragslaufzeit: string>"
)
_PREMIUM = "beitrag struct<monatlich_eur: double, jaehrlich_eur: double, quelle: string>"
_RATING = "array<struct<source: string, badge: string, sentiment: string, scope: string, verdict: string, evidence: array<string>, stand: string, url: string>>"

RECORD = (
    f"insurer string, tariff string, stand string, {_MODULES}, {_COVERAGE}, leistungen array<string>, ausschluesse array<string>, "
    f"besonderheiten array<string>, {_PREMIUM}, sources array<struct<doctype: string, content_sha256: string>>, _input_hash string, "
    "_model string, _filter string, _repeat int, _repeat_ok int, _curated boolean, _reconciled boolean, _shared_from string"
)
OFFER = (
    "quelle string, doctype string, beitrag struct<monatlich_eur: double, jaehrlich_eur: double>, "
    "modules map<string, struct<level: string>>, coverage struct<selbstbeteiligung: string>"
)
SNAPSHOT = (
    "date string, profile string, source string, count int, tariffs array<struct<position: int, insurer: string, product: string, "
    "tarifnote: string, monatlich_eur: double, selbstbeteiligung: string, bewertung: double, bewertung_anzahl: int, "
    "wartezeit_per_modul: map<string, string>, key: string, bewertung_stand: string>>"
)
DELIMITED = "position int, insurer string, product string, tarifnote string, monatlich_eur string, selbstbeteiligung string"
MANIFEST = (
    "tariffs array<struct<stem: string, insurer: string, tariff: string, position: int, hash: string, harvested: string, "
    "docs: array<struct<doctype: string, kind: string, file: string, url: string>>>>"
)
BENCHMARK = (
    "rows array<struct<tariff: string, model: string, input: string, runs: int, ok: int, schema_ok: int, faithful: int, "
    "modules_min: int, modules_max: int, unsupported_max: int, cost_usd: double, wall_s: double>>"
)
RATINGS = f"tariffs map<string, {_RATING}>, tariff_aliases map<string, string>, insurers map<string, {_RATING}>"
TAXONOMY = "taxonomy map<string, array<struct<key: string, label_de: string, synonyms: array<string>>>>"
