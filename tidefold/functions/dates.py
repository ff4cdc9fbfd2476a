"""Completed years and months between two dates.

Both count by calendar fields: a 29 February birthday is reached on 1 March of
common years, which ``months_between`` does not give.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold import codes


def age_years(birth: Column, on: Column) -> Column:
    """Completed years; null if ``birth`` lies after ``on``."""
    before_birthday = (F.month(on) * 100 + F.day(on)) < (F.month(birth) * 100 + F.day(birth))
    years = F.year(on) - F.year(birth) - before_birthday.cast("int")
    return F.when(birth <= on, years)


def age_months(birth: Column, on: Column) -> Column:
    """Completed months; null if ``birth`` lies after ``on``."""
    months = (F.year(on) - F.year(birth)) * 12 + (F.month(on) - F.month(birth))
    return F.when(birth <= on, months - (F.day(on) < F.day(birth)).cast("int"))


def maturity_age(option: Column) -> Column:
    """The age at which cover ends, by maturity option."""
    age = F.lit(codes.MATURITY_AGE_OTHERWISE)
    for chosen, at in codes.MATURITY_AGE.items():
        age = F.when(option == chosen, at).otherwise(age)
    return age
