"""Ordered rules as data: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default rule sets. Each entry is (label, match kind, words).
FIELD_CATEGORIES = (
    ("Identity & Authentication", "contains", ("account", "shopper", "id")),
    ("Billing & Payments", "contains", ("billing", "payment", "commitment", "autorenew")),
    ("Entitlements & Permissions", "contains", ("entitlement", "current", "transitionable")),
    ("Features & Configuration", "contains", ("feature", "widget", "published")),
    ("Social Media & Marketing", "contains", ("facebook", "instagram", "social", "gem")),
    ("Commerce & Products", "contains", ("product", "commerce", "ols", "marketplace")),
    ("Appointments & Services", "contains", ("appointment", "ola", "service", "calendar")),
    ("Status & Types", "contains", ("type", "status")),
)
USAGE_PATTERNS = (
    ("billing", "contains", ("billing", "payment")),
    ("entitlements", "contains", ("entitlement", "current")),
    ("features", "contains", ("feature", "widget")),
    ("social_media", "contains", ("facebook", "instagram", "social")),
    ("commerce", "contains", ("product", "commerce", "ols")),
    ("appointments", "contains", ("appointment", "ola", "service")),
    ("authentication", "contains", ("account", "shopper")),
)
DATA_TYPES = (
    ("number", "contains", ("Count", "total", "number")),
    ("datetime", "contains", ("Date", "date", "Time", "time")),
    ("boolean", "contains", ("is", "has", "Enabled", "Connected", "Published")),
    ("enum", "contains", ("Status", "status", "Type", "type")),
    ("identifier", "contains", ("Id", "id", "ID")),
    ("array/object", "contains", ("widgets", "data", "intentions")),
)
HEAD_CATEGORIES = (
    ("Identity & Core Data", "head", ("account", "entity")),
    ("Billing & Payments", "head", ("billing", "payment")),
    ("Entitlements & Permissions", "head", ("entitlements",)),
    ("Website Configuration", "head", ("website",)),
    ("Marketing & Social", "head", ("email", "social")),
    ("E-commerce", "head", ("commerce",)),
    ("Appointments & Services", "head", ("appointments",)),
    ("Customer Data", "head", ("customer",)),
    ("Navigation Links", "head", ("links",)),
    ("Request Context", "head", ("context",)),
)


def matches(col: Column, kind: str, words: Sequence[str]) -> Column:
    tests = {
        "contains": lambda w: col.contains(w),
        "prefix": lambda w: col.startswith(w),
        "head": lambda w: F.element_at(F.split(col, r"\."), 1) == w,
        "equals": lambda w: col == w,
        "regex": lambda w: col.rlike(w),
    }
    return reduce(lambda a, b: a | b, [tests[kind](w) for w in words])


def categorize(col: Column, rules, default: str = "Other", ignore_case: bool = False) -> Column:
    """Label of the first rule that matches ``col``; ``default`` when none does."""
    subject = F.lower(col) if ignore_case else col
    out = None
    for label, kind, words in rules:
        test = matches(subject, kind, words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def infer_dtype(col: Column, rules=DATA_TYPES) -> Column:
    return categorize(col, rules, default="string")


# Categories whose sub-category is the path's head, one with a fixed sub-category, and the default's.
HEAD_SUBCATEGORY = ("Identity & Core Data", "Marketing & Social")
FIXED_SUBCATEGORY = (("Billing & Payments", "billing"), ("Other", "uncategorized"))


def subcategory(col: Column, category: Column) -> Column:
    """By category: the head of the path, a fixed word, or the second segment (``general`` for a one-segment path)."""
    parts = F.split(col, r"\.")
    out = F.when(category.isin(*HEAD_SUBCATEGORY), F.element_at(parts, 1))
    for name, word in FIXED_SUBCATEGORY:
        out = out.when(category == name, word)
    return out.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise("general")


def normalize_prefix(col: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """Replaces the first prefix of ``mapping`` (in order) that ``col`` starts with."""
    out = None
    for old, new in mapping:
        value = F.concat(F.lit(new), F.substring(col, len(old) + 1, 1 << 30))
        out = F.when(col.startswith(old), value) if out is None else out.when(col.startswith(old), value)
    return out.otherwise(col) if out is not None else col


def has_prefix(col: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [col.startswith(old) for old, _ in mapping])
