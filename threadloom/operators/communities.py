"""The community dimension: general, health and other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Communities of the two study groups, compared without case.
GENERAL = tuple("AskReddit AmItheAsshole relationship_advice relationships legaladvice Advice teenagers childfree askscience science Fitness psychology".split())
HEALTH = tuple(
    """ADHD AlternativeHealth Amblyopia Anxiety AskDocs AskDoctorSmeeee Asthma BPD BabyBumps BipolarReddit CaregiverSupport ChronicPain CrohnsDisease Dentistry
    Depression DiagnoseMe Dystonia Fibromyalgia Gastroparesis Hemophilia Hypothyroidism Interstitialcystitis Keratoconus KidneyStones Menieres MultipleSclerosis
    Psoriasis STD SkincareAddiction SleepApnea SuicideWatch Testosterone aspergers birthcontrol cancer cfs chd dementia diabetes dysautonomia eczema flu gravesdisease
    healthcare ibs infertility lactoseintolerant maculardegeneration medical medicine mentalhealth nutrition optometry pancreaticcancer pharmacy pilonidalcyst pregnant
    publichealth rheumatoid stopsmoking transplant troubledteens""".split()
)


def community_type(name: Column, general: Iterable[str] = GENERAL, health: Iterable[str] = HEALTH) -> Column:
    """``general``, ``health`` or ``other`` by exact name without case; null is ``other``."""
    low = F.lower(name)
    return F.when(low.isin(*[g.lower() for g in general]), "general").when(low.isin(*[h.lower() for h in health]), "health").otherwise("other")
