"""What each listing phrase of the views means, stated phrase by phrase.

The SQL of the feature queries is built from these statements, not from the library's
patterns, so that a wrong pattern shows as a difference.
"""

from __future__ import annotations

# Phrase, yes/no columns it sets, labels it gives. Phrases that set
# nothing here are negatives, or concern the columns with rules of their own.
STATED: tuple[tuple[str, str, dict[str, str]], ...] = (
    ("Garage and driveway", "", {"parking": "Garage"}),
    ("Private rear garden", "rear_garden", {}),
    ("Top floor apartment", "", {"floor_level": "Top"}),
    ("Double glazing", "double_glazed", {}),
    ("South facing garden", "", {"garden_facing": "South"}),
    ("Victorian terrace", "", {"property_era": "Victorian"}),
    ("Open plan kitchen", "open_plan", {"kitchen_type": "Open Plan"}),
    ("En-suite shower room", "ensuite shower_room", {}),
    ("Study", "study", {}),
    ("Lift access", "lift", {}),
    ("Off street parking", "", {"parking": "Off-street"}),
    ("Underfloor heating", "underfloor_heating", {}),
    ("Roof terrace", "roof_terrace", {}),
    ("Sea views", "views sea_views", {}),
    ("Potential to extend STPP", "potential_to_extend", {}),
    ("Extended family home", "extended", {}),
    ("Side return extension", "extended", {}),
    ("Basement storage", "cellar", {"floor_level": "Basement"}),
    ("Immaculate condition", "", {"condition": "Immaculate"}),
    ("Living room", "separate_living_room", {}),
    ("Grade II listed building", "listed_building", {}),
    ("Third floor", "", {"floor_level": "Third"}),
    ("Fireplace", "fireplace", {}),
    ("Porch", "porch", {}),
    ("Utility room", "utility_room", {}),
    ("Newly refurbished", "refurbished", {}),
    ("Cul-de-sac location", "cul_de_sac", {}),
)

MORE: tuple[tuple[str, str, dict[str, str]], ...] = (
    ("Period features throughout", "period_property", {}),
    ("Conservatory", "conservatory", {}),
    ("Downstairs WC", "cloakroom", {}),
    ("Wooden floors", "wooden_floors", {}),
    ("Residents gym", "gym", {}),
    ("Gymnasium nearby", "", {}),
    ("Lift to all floors", "", {}),
    ("Lift", "lift", {}),
    ("Dining room", "dining_room", {}),
    ("EV charging point", "ev_charger", {}),
    ("Log burner", "fireplace", {}),
    ("Large bright study on the upper landing", "", {}),
    ("Home office", "study", {}),
    ("Fitted wardrobes", "fitted_wardrobes", {}),
    ("New build", "new_build", {}),
    ("24 hour concierge", "concierge", {}),
    ("Swimming pool", "swimming_pool", {}),
    ("Air conditioning", "air_conditioning", {}),
    ("Solar panels", "solar_panels", {}),
    ("Loft storage", "loft", {}),
    ("Lofty ceilings", "", {}),
    ("Entrance hall", "entrance_hall", {}),
    ("Dishwasher included", "white_goods", {}),
    ("Bay window to front", "bay_window", {}),
    ("Intercom", "intercom", {}),
    ("Split level layout", "split_level", {}),
    ("Basement flat", "", {"floor_level": "Basement"}),
    ("High ceilings", "high_ceilings", {}),
    ("Gated community", "gated", {}),
    ("Purpose-built block", "purpose_built", {}),
    ("Duplex", "duplex", {}),
    ("Penthouse", "penthouse", {}),
    ("Own front door", "own_front_door", {}),
    ("Private entrance", "private_entrance", {}),
    ("Cycle storage", "bike_storage", {}),
    ("Conservation area", "conservation_area", {}),
    ("Annexe", "annexe", {}),
    ("Underground parking", "underground_parking", {"parking": "Parking"}),
    ("Allocated parking", "allocated_parking", {"parking": "Parking"}),
    ("Driveway", "", {"parking": "Driveway"}),
    ("Ground floor flat", "", {"floor_level": "Ground"}),
    ("First floor flat", "", {"floor_level": "First"}),
    ("Second floor flat", "", {"floor_level": "Second"}),
    ("5th floor flat", "", {"floor_level": "Upper"}),
    ("West facing garden", "", {"garden_facing": "West"}),
    ("East facing garden", "", {"garden_facing": "East"}),
    ("North facing courtyard", "", {"garden_facing": "North"}),
    ("Edwardian character", "", {"property_era": "Edwardian"}),
    ("Georgian townhouse", "", {"property_era": "Georgian"}),
    ("Art deco building", "", {"property_era": "Art Deco"}),
    ("Excellent condition", "", {"condition": "Excellent"}),
    ("Good condition", "", {"condition": "Good"}),
    ("Fair condition", "air_conditioning", {"condition": "Fair"}),
    ("Kitchen diner", "", {"kitchen_type": "Kitchen Diner"}),
    ("Eat-in kitchen", "", {"kitchen_type": "Eat-in"}),
    ("Separate kitchen", "", {"kitchen_type": "Separate"}),
    ("Potential to be extended", "", {}),
    ("Garden room", "outbuilding", {}),
    ("Walk-in wardrobe", "walk_in_wardrobe", {}),
    ("Wet room", "wet_room", {}),
    ("Integrated appliances", "integrated_appliances", {}),
    ("Side access", "side_access", {}),
    ("Video entry system", "video_entry", {}),
    ("Living room with fire", "", {}),
    ("Spacious living room", "separate_living_room", {}),
    ("Laminate flooring", "laminate_flooring", {}),
    ("Corner plot", "corner_plot", {}),
    ("End of terrace", "end_terrace", {}),
    ("Mid-terrace house", "mid_terrace", {}),
    ("Bungalow", "bungalow", {}),
    ("Double garage", "double_garage", {"parking": "Garage"}),
    ("Integral garage", "integral_garage", {"parking": "Garage"}),
    ("Through lounge", "through_lounge", {}),
    ("Breakfast bar", "breakfast_kitchen", {}),
    ("Front garden", "front_garden", {}),
    ("Well-stocked garden", "mature_garden", {}),
    ("Family bathroom", "family_bathroom", {}),
    ("Guest WC", "guest_wc", {}),
    ("Guest cloakroom", "guest_wc cloakroom", {}),
    ("Dressing room", "dressing_room", {}),
    ("Snug", "snug", {}),
    ("Orangery", "orangery", {}),
    ("Pantry", "pantry", {}),
    ("Boot room", "boot_room", {}),
    ("Games room", "games_room", {}),
    ("Home cinema", "cinema_room", {}),
    ("Reception hall", "reception_hall", {}),
    ("Garage conversion", "garage_conversion", {"parking": "Garage"}),
    ("In need of modernisation", "needs_modernisation", {}),
    ("Vacant possession", "vacant_possession", {}),
    ("Original features", "original_features", {}),
    ("Period conversion", "period_conversion", {}),
    ("Rolling views", "countryside_views", {}),
    ("Rural views", "views countryside_views", {}),
    ("River views", "views", {}),
    ("Reviews available", "", {}),
    ("Burglar alarm", "alarm_system", {}),
    ("Electric gates", "electric_gates", {}),
    ("Equestrian facilities", "stables", {}),
    ("Jacuzzi", "hot_tub", {}),
    ("Sauna", "sauna", {}),
    ("Wine cellar", "wine_cellar cellar", {}),
    ("First time buyers", "first_time_buy", {}),
    ("Service charge £1,165 per annum", "", {}),
    ("Ground rent £250 pa", "", {}),
)
LABELLED = ("parking", "floor_level", "garden_facing", "property_era", "condition", "kitchen_type")


def setting(column: str) -> list[str]:
    """Phrases that set a yes/no column."""
    return [p for p, columns, _ in STATED + MORE if column in columns.split()]


def labels(column: str) -> dict[str, str]:
    return {p: found[column] for p, _, found in STATED + MORE if column in found}


def more_case(number: str) -> str:
    """SQL that picks one of MORE by a number."""
    return f"CASE ({number}) % {len(MORE)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _, _) in enumerate(MORE)) + " END"
