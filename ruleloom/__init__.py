"""Explainable clustering on Spark: rules, trees and decision sets over DataFrames."""

from .model import Condition, Node, Rule, RuleSet

__all__ = ["Condition", "Node", "Rule", "RuleSet"]
