"""The default crosswalk of treatment descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "field string, value string, activity string, effect string, confidence string"

# Field, value, activity, effect, confidence.
ROWS = [
    ("type", "Thinning", "Thin", "canopy", "high"),
    ("type", "Broadcast", "Broadcast Burn", "canopy", "high"),
    ("type", "Broadcast Burn", "Broadcast Burn", "canopy", "high"),
    ("type", "Mastication", "Mastication", "canopy", "high"),
    ("type", "Grinding, Chipping, Crushing", "Mastication", "canopy", "high"),
    ("type", "Crushing", "Mastication", "canopy", "medium"),
    ("type", "Fuel Compaction", "Mastication", "canopy", "medium"),
    ("type", "Chipping", "Mastication", "canopy", "medium"),
    ("type", "Machine Pile", "Pile Fuels", "surface", "high"),
    ("type", "Hand Pile", "Pile Fuels", "surface", "high"),
    ("type", "Pile", "Pile Fuels", "surface", "high"),
    ("type", "Machine Pile Burn", "Pile Burn", "surface", "high"),
    ("type", "Hand Pile Burn", "Pile Burn", "surface", "high"),
    ("type", "Pile Burn", "Pile Burn", "surface", "high"),
    ("type", "Jackpot Burn", "Pile Burn", "surface", "medium"),
    ("type", "Lop and Scatter", "Lop and Scatter", "surface", "high"),
    ("type", "Biomass Removal", "Removal", "surface", "medium"),
    ("type", "Mowing", "DROP", "none", "high"),
    ("type", "Grazing", "DROP", "none", "high"),
    ("type", "Biological", "DROP", "none", "high"),
    ("type", "Chemical", "DROP", "none", "high"),
    ("type", "Chemical Treatment - Herbicide", "DROP", "none", "high"),
    ("type", "Herbicide", "DROP", "none", "high"),
    ("type", "Planting", "DROP", "none", "high"),
    ("type", "Seeding", "DROP", "none", "high"),
    ("activity", "Thinning for Hazardous Fuels Reduction", "Thin", "canopy", "high"),
    ("activity", "Precommercial Thin", "Thin", "canopy", "high"),
    ("activity", "Precommercial thinning for visual", "Thin", "canopy", "high"),
    ("activity", "Wildlife Habitat Precommercial thinning", "Thin", "canopy", "high"),
    ("activity", "Commercial Thin", "Thin", "canopy", "high"),
    ("activity", "Stand Clearcut (EA/RH/FH)", "Mechanical", "canopy", "high"),
    ("activity", "Stand Clearcut (w/ leave trees) (EA/RH/FH)", "Mechanical", "canopy", "high"),
    ("activity", "Patch Clearcut (EA/RH/FH)", "Mechanical", "canopy", "high"),
    ("activity", "Patch Clearcut (w/ leave trees) (EA/RH/FH)", "Mechanical", "canopy", "high"),
    ("activity", "Two-aged Patch Clearcut (w/res) (2A/RH/FH)", "Mechanical", "canopy", "high"),
    ("activity", "Harvest Without Restocking", "Mechanical", "canopy", "high"),
    ("activity", "Permanent Land Clearing", "Mechanical", "canopy", "high"),
    ("activity", "Fuel Break", "Mechanical", "canopy", "high"),
    ("activity", "Salvage Cut (intermediate treatment, not regeneration)", "Mechanical", "canopy", "high"),
    ("activity", "Landing Treated - Area Mitigated", "Mechanical", "canopy", "medium"),
    ("activity", "Recreation Removal of hazard trees and snags - Area", "Mechanical", "canopy", "medium"),
    ("activity", "Site Preparation for Natural Regeneration - Mechanical", "Mechanical", "canopy", "low"),
    ("activity", "Site Preparation for Planting - Mechanical", "Mechanical", "canopy", "low"),
    ("activity", "Group Selection Method (UA/RH/FH)", "Manual", "canopy", "high"),
    ("activity", "Single Tree Selection Method (UA/RH/FH)", "Manual", "canopy", "high"),
    ("activity", "Overstory Removal Cut (from advanced regeneration) (EA/RH/FH)", "Manual", "canopy", "medium"),
    ("activity", "Special Products Removal", "Manual", "canopy", "medium"),
    ("activity", "Sanitation Cut", "Manual", "canopy", "medium"),
    ("activity", "Improvement Cut", "Manual", "canopy", "medium"),
    ("activity", "Other Stand Tending", "Manual", "canopy", "low"),
    ("activity", "Prune", "Manual", "canopy", "low"),
    ("activity", "Pruning to Raise Canopy Height and Discourage Crown Fire", "Manual", "canopy", "medium"),
    ("activity", "Slashing - Pre-Site Preparation", "Manual", "canopy", "medium"),
    ("activity", "Wildlife Habitat Regeneration cut", "Mechanical", "canopy", "medium"),
    ("activity", "Seed-tree Seed Cut (with and without leave trees) (EA/RH/NFH)", "Mechanical", "canopy", "medium"),
    ("activity", "Seed-tree Final Cut (EA/NRH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Seed-tree Removal Cut (w/ leave trees) (EA/NRH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Shelterwood Establishment Cut (with or without leave trees) (EA/RH/NFH)", "Mechanical", "canopy", "medium"),
    ("activity", "Shelterwood Preparatory Cut (EA/NRH/NFH)", "Mechanical", "canopy", "medium"),
    ("activity", "Shelterwood Removal Cut (EA/NRH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Shelterwood Removal Cut (w/ leave trees) (EA/NRH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Two-aged Preparatory Cut (w/res) (2A/NRH/NFH)", "Mechanical", "canopy", "medium"),
    ("activity", "Two-aged Shelterwood Establishment and Removal Cut (w/ res) (2A/RH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Two-aged Shelterwood Final Removal Cut (w/res) (2A/NRH/FH)", "Mechanical", "canopy", "medium"),
    ("activity", "Broadcast Burning - Covers a majority of the unit", "Broadcast Burn", "canopy", "high"),
    ("activity", "Underburn - Low Intensity (Majority of Unit)", "Broadcast Burn", "canopy", "high"),
    ("activity", "Jackpot Burning - Scattered concentrations", "Pile Burn", "surface", "medium"),
    ("activity", "Site Preparation for Natural Regeneration - Burning", "Broadcast Burn", "canopy", "medium"),
    ("activity", "Wildlife Habitat Prescribed fire", "Broadcast Burn", "canopy", "medium"),
    ("activity", "Tree Release and Weed", "Release", "canopy", "high"),
    ("activity", "Site Preparation for Natural Regeneration - Other", "Mechanical", "canopy", "low"),
    ("activity", "Burning of Piled Material", "Pile Burn", "surface", "high"),
    ("activity", "Piling of Fuels, Hand or Machine", "Pile Fuels", "surface", "high"),
    ("activity", "Yarding - Removal of Fuels by Carrying or Dragging", "Removal", "surface", "high"),
    ("activity", "Chipping of Fuels", "Mastication", "surface", "medium"),
    ("activity", "Compacting/Crushing of Fuels", "Mastication", "surface", "medium"),
    ("activity", "Rearrangement of Fuels", "Lop and Scatter", "surface", "high"),
    ("activity", "Invasives - Mechanical /Physical", "DROP", "none", "high"),
    ("activity", "Invasives - Pesticide Application", "DROP", "none", "high"),
    ("activity", "Grazing and Range Mgt. for Hazardous Fuels Reduction", "DROP", "none", "high"),
    ("activity", "Wildfire - Human Ignition", "DROP", "none", "high"),
    ("activity", "Stocking Survey", "DROP", "none", "medium"),
    ("activity", "Certification of Natural Regeneration without Site Prep", "DROP", "none", "medium"),
    ("method", "Manual", "Manual", "canopy", "medium"),
    ("method", "Manual Logging", "Manual", "canopy", "medium"),
    ("method", "Power Hand", "Manual", "canopy", "medium"),
    ("method", "Cut trees and brush", "Manual", "canopy", "low"),
    ("method", "Girdle", "Manual", "canopy", "low"),
    ("method", "Mechanical", "Mechanical", "canopy", "medium"),
    ("method", "Tractor Logging", "Mechanical", "canopy", "medium"),
    ("method", "Logging Methods", "Mechanical", "canopy", "low"),
    ("method", "Helicopter", "Mechanical", "canopy", "low"),
    ("method", "Highlead", "Mechanical", "canopy", "low"),
    ("method", "Jammer", "Mechanical", "canopy", "low"),
    ("method", "Single Span Skyline", "Mechanical", "canopy", "low"),
    ("method", "Stump shearing", "Mechanical", "canopy", "low"),
    ("method", "Crushing, pushing", "Mastication", "canopy", "low"),
    ("method", "Chipping", "Mastication", "surface", "low"),
    ("method", "Utilizer - Chip", "Mastication", "surface", "low"),
    ("method", "Fire", "Broadcast Burn", "canopy", "low"),
    ("method", "Prescribed Burn", "Broadcast Burn", "canopy", "low"),
    ("method", "Hand piling", "Pile Fuels", "surface", "medium"),
    ("method", "Mechanical pile", "Pile Fuels", "surface", "medium"),
    ("method", "Removal", "Removal", "surface", "low"),
    ("method", "Chemical", "DROP", "none", "high"),
    ("method", "Mobile Ground", "DROP", "none", "high"),
    ("method", "Animal", "DROP", "none", "high"),
    ("method", "Firewood Removal", "DROP", "none", "high"),
    ("method", "Wildfire", "DROP", "none", "high"),
    ("method", "Maintenance", "DROP", "none", "low"),
    ("method", "Not Applicable", "DROP", "none", "low"),
    ("twig_category", "Mechanical", "Thin", "canopy", "low"),
    ("twig_category", "Planned Ignition", "Broadcast Burn", "canopy", "low"),
    ("twig_category", "Chemical", "DROP", "none", "high"),
    ("twig_category", "Biological", "DROP", "none", "high"),
    ("twig_category", "Unplanned Ignition", "DROP", "none", "high"),
    ("twig_category", "Natural Resources", "DROP", "none", "low"),
    ("activity", "Wildland Fire Use", "Fire Use", "canopy", "high"),
    ("activity", "Wildfire - Fuels Benefit", "Fire Use", "canopy", "high"),
    ("activity", "Planned Treatment Burned in Wildfire", "Fire Use", "canopy", "medium"),
    ("type", "Fire Use", "Fire Use", "canopy", "medium"),
    ("activity", "Pollinator habitat improved, restored or maintained", "Range", "canopy", "high"),
    ("activity", "Range Cover Manipulation", "Range", "canopy", "high"),
    ("activity", "Range Control Vegetation", "Range", "canopy", "high"),
    ("activity", "Range Forage Improvement", "Range", "canopy", "medium"),
]


def default_crosswalk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)
