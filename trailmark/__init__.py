"""Campaign analytics on PySpark: lazy DataFrame -> DataFrame operators."""

from trailmark.params import CampaignPlan, CensoringPolicy

__all__ = ["CampaignPlan", "CensoringPolicy"]
