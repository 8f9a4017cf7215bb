"""Recognising algorithmic patterns in source code. Code is parsed, never run."""

from kalmia.operators.detect.engine import analyze, analyze_codes, register_udtf
from kalmia.operators.detect.rules import DETECTORS

__all__ = ["DETECTORS", "analyze", "analyze_codes", "register_udtf"]
