"""Column names and values of the service-case tables, and which column plays which part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names the yearly call tables drifted to, and the columns they gained by accident.
CALL_RENAMES = {
    "Product  Type": "Report Type",
    "CountryOfOrigin": "Country Of Origin",
    "RSACarried Out By": "RSA Carried Out By",
    "RSASuccessful": "RSA Successful",
    "Reason Courtesy Call ": "Reason Courtesy Call",
}
CALL_DROPS = ("a", "b")

# yes/no columns that name a service.
SERVICES = (
    "Rental Car",
    "Hotel Service",
    "Alternative Transport",
    "Taxi Service",
    "Vehicle Transport",
    "Car Key Service",
    "Parts Service",
    "Additional Services Not Covered",
)

# Columns of a raw call, all read as text.
RAW_CALL_COLUMNS = (
    "Case Number",
    "VIN",
    "Report Type",
    "Incident Date",
    "Time Of Call",
    "Time Of Arrival",
    "Registration Date",
    "Policy Start Date",
    "Policy End Date",
    "Monat",
    "Reason Of Call",
    "Odometer",
    "Btype",
    "Typ aus VIN",
    "Country Of Origin",
    "Country Of Incident",
    "Handling Call Center",
    "Component",
    "Outcome Description",
    *SERVICES,
    "Damage During Assistance",
    "Telephone Help",
    "Service Paid By Customer",
    "Replacement Car Days",
    "RSA Carried Out By",
    "RSA Successful",
    "Fault Description Customer",
)
RAW_CALLS = T.StructType([T.StructField(c, T.StringType()) for c in RAW_CALL_COLUMNS])

# Columns of the repair lines, their ends and the vehicle models.
RAW_LINES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Q-Line", "FIN", "Reparaturbeginndatum", "Werkstattaufenthalt")]
)
RAW_ENDS = T.StructType([T.StructField(c, T.StringType()) for c in ("Q-Line", "Reparaturendedatum")])
VEHICLE_MODELS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Bestelltypschlüssel", "Baureihe", "Modellreihe", "Fahrzeuggruppe")]
)

# Reasons of a call by code.
REASONS = {
    "1": "Breakdown - Technical defect",
    "2": "Breakdown - Misuse",
    "3": "Accident",
    "4": "Others",
    "5": "Theft",
    "6": "Vandalism",
    "7": "Tyre Breakdown",
    "8": "Tyre Accident",
}

# Order of the leading columns of a cleaned call.
CALL_ORDER = (
    "Case Number",
    "VIN",
    "Report Type",
    "Incident Date",
    "Registration Date",
    "Policy Start Date",
    "Policy End Date",
    "Policy Duration",
    "Country Of Origin",
    "Country Of Incident",
    "Handling Call Center",
    "Bestelltypschlüssel",
    "Baureihe",
    "Modellreihe",
    "Fahrzeuggruppe",
    "Odometer",
    "Time Of Arrival",
    "CTA",
    "Component",
    "Outcome Description",
    "Reason Of Call",
)

# The nine suspicion flags.
FLAGS = (
    "SuS_Anruferzahl",
    "SuS_Vertragszeitraum",
    "SuS_Services_Offered",
    "SuS_AnrufeInFall",
    "SuS_Rental_Car",
    "SuS_Breakdown",
    "SuS_Abschleppungen",
    "SuS_Merged",
    "SuS_Call_while_car_in_workshop",
)

# Country names by code; two countries have two codes.
COUNTRIES = {
    "DE": "Germany",
    "PL": "Poland",
    "FR": "France",
    "NL": "Netherlands",
    "CH": "Switzerland",
    "NO": "Norway",
    "BE": "Belgium",
    "ES": "Spain",
    "IT": "Italy",
    "SE": "Sweden",
    "DK": "Denmark",
    "RO": "Romania",
    "TR": "Turkey",
    "PT": "Portugal",
    "CZ": "Czech Republic",
    "FI": "Finland",
    "LT": "Lithuania",
    "UA": "Ukraine",
    "SK": "Slovakia",
    "EE": "Estonia",
    "HR": "Croatia",
    "HU": "Hungary",
    "TK": "Turkey",
    "LU": "Luxembourg",
    "LV": "Latvia",
    "SI": "Slovenia",
    "BG": "Bulgaria",
    "BY": "Belarus",
    "RS": "Serbia",
    "GR": "Greece",
    "CY": "Cyprus",
    "BA": "Bosnia and Herzegovina",
    "GB": "United Kingdom",
    "IS": "Iceland",
    "MK": "North Macedonia",
    "AT": "Austria",
    "N": "Norway",
    "MD": "Moldova",
    "IE": "Ireland",
    "MT": "Malta",
    "LI": "Liechtenstein",
    "AD": "Andorra",
    "RU": "Russia",
}


@dataclass(frozen=True)
class Calls:
    """Columns of a call table. ``tie`` makes calls of an entity at one time unique."""

    entity: str = "VIN"
    case_number: str = "Case Number"
    at: str = "Incident Date"
    outcome: str = "Outcome Description"
    tows: tuple[str, ...] = ("Towing", "Scheduled Towing")
    services: tuple[str, ...] = SERVICES
    rental_days: str = "Rental Car Days"
    policy_start: str = "Policy Start Date"
    policy_end: str = "Policy End Date"
    tie: tuple[str, ...] = ("_src", "Baureihe", "Modellreihe")
    case_id: str = "Fall_ID"
    gap: str = "days_since_last_towing"


@dataclass(frozen=True)
class Repairs:
    """Columns of a table of repair lines. ``tie`` makes lines unique."""

    entity: str = "VIN"
    line: str = "Q-Line"
    start: str = "Reparaturbeginndatum"
    end: str = "Reparaturendedatum"
    stay_number: str = "Werkstattaufenthalt"
    tie: tuple[str, ...] = ("Q-Line",)
    stay_id: str = "Aufenthalt_ID"
    days: str = "stay_days"
