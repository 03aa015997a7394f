"""Domain constants, overridable as one object."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Constants:
    # They must equal the published method for results to match.
    biomass_to_carbon: float = 0.464
    kg_per_100m2_to_mg_per_ha: float = 10.0
    carbon_to_co2: float = 3.67
    zero_carbon_floor_perc: float = 0.001
    pipe_diameter_cm: float = 5.0
    survey_year: int = 2017
    young_stand_from_year: int = 1992
    reference_plot_year: str = "1970"
    excluded_treatment: str = "Saltmarsh_natural"


DEFAULTS = Constants()

# Site types, in the order figures list them.
CONVERTED = "Converted"
ESTABLISHED = "Established"
REHABILITATED = "Rehabilitated"
REHABILITATED_YOUNG = "Rehabilitated_young"
REHABILITATED_OLD = "Rehabilitated_old"
TYPE_LEVELS = (CONVERTED, ESTABLISHED, REHABILITATED_YOUNG, REHABILITATED_OLD)
