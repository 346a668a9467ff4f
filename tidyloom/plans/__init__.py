from tidyloom.plans.model import PlanCleaner, PlanModel
from tidyloom.plans.presets import fallback_plan, fixed_plan, raw_plan
from tidyloom.plans.registry import register_action, registered
from tidyloom.plans.runner import run_fixed, run_plan

__all__ = [
    "PlanCleaner", "PlanModel", "fallback_plan", "fixed_plan", "raw_plan",
    "register_action", "registered", "run_fixed", "run_plan",
]
