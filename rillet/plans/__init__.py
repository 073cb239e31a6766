"""Composition of steps and plan inspection."""

from rillet.plans.compose import chain
from rillet.plans.inspect import physical_plan, plan_has

__all__ = ["chain", "physical_plan", "plan_has"]
