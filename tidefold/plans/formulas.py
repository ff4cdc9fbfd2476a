"""One policy year as formulas, each stated once.

A formula is a function whose parameters name its inputs and whose name is its
result; ``o`` holds the few operations that columns and arrays spell differently.
The same formulas run as Catalyst columns, for all result columns, and as NumPy
arrays inside the roll-forward, which carries account values between years.
Operation order is part of each formula, so both give the same doubles.
"""

from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold import codes


def _column(value):
    return value if isinstance(value, Column) else F.lit(value)


class ColumnOps:
    @staticmethod
    def where(condition, then, otherwise):
        # ``if`` generates much smaller code than a one-branch CASE
        return F.call_function("if", condition, _column(then), _column(otherwise))

    @staticmethod
    def maximum(a, b):
        return ColumnOps.where(a > b, a, b)

    @staticmethod
    def minimum(a, b):
        return ColumnOps.where(a < b, a, b)

    @staticmethod
    def ceil(a):
        return F.ceil(a).cast("double")


class ArrayOps:
    where = staticmethod(np.where)
    maximum = staticmethod(np.maximum)
    minimum = staticmethod(np.minimum)
    ceil = staticmethod(np.ceil)


# -- premiums and charges ----------------------------------------------------

def tp_term_flag(o, year, tp_term):
    return year <= tp_term


def ep_term_flag(o, year, ep_term):
    return year <= ep_term


def tp(o, year, tp_1, big_case_bonus, tp_term_flag):
    annual = o.where(year == 1, tp_1 + big_case_bonus, tp_1)
    return o.where(tp_term_flag, annual, 0.0)


def ep(o, year, ep_1, ep_paid_term):
    return o.where(year <= ep_paid_term, ep_1, 0.0)


def srr_chrg(o, tp, srr_chrg_rate):
    return tp * srr_chrg_rate


def tp_alloc_chrg(o, tp, tp_alloc_chrg_rate):
    return tp * tp_alloc_chrg_rate


def ep_alloc_chrg(o, ep, ep_alloc_chrg_rate):
    return ep * ep_alloc_chrg_rate


def tp_alloc(o, tp, tp_alloc_chrg):
    return tp - tp_alloc_chrg


def ep_alloc(o, ep, ep_alloc_chrg):
    return ep - ep_alloc_chrg


# -- values at the start of the year -----------------------------------------

def start_pav(o, start_tav, start_eav):
    return start_tav + start_eav


def srr_val(o, start_tav, srr_chrg, start_eav):
    return o.maximum(start_tav - srr_chrg, 0.0) + start_eav


def ben(o, option_a, start_si, start_pav, juvenile_lien_rate):
    return o.where(option_a, o.maximum(start_si, start_pav), start_si) * juvenile_lien_rate


def acc_ben(o, start_si, acc_ben_coeff, acc_ben_term_flag):
    return o.where(acc_ben_term_flag, start_si * acc_ben_coeff, 0.0)


# -- planned withdrawal ------------------------------------------------------

def asked_eav(o, start_eav, withdrawal_input):
    return o.minimum(start_eav, withdrawal_input)


def asked_tav(o, withdrawal_input, asked_eav):
    return withdrawal_input - asked_eav


def asked_end_pav(o, start_eav, asked_eav, start_tav, asked_tav):
    return (start_eav - asked_eav) + (start_tav - asked_tav)


def asked_end_si(o, option_a, start_si, start_pav, withdrawal_input):
    return o.where(option_a, start_si, o.maximum(start_pav, start_si) - withdrawal_input)


def withdrawal_outcome(
    o, withdrawal_input, start_pav, asked_end_pav, tp_1, asked_end_si, min_si
):
    """0 none asked, 1 over the account, 2 account too low, 3 cover too low, 4 paid."""
    return o.where(
        withdrawal_input == 0.0, 0,
        o.where(withdrawal_input > start_pav, 1,
                o.where(asked_end_pav < tp_1, 2, o.where(asked_end_si < min_si, 3, 4))),
    )


def withdrawal(o, withdrawal_outcome, withdrawal_input):
    return o.where(withdrawal_outcome == 4, withdrawal_input, 0.0)


def eav_withdrawal(o, withdrawal_outcome, asked_eav):
    return o.where(withdrawal_outcome == 4, asked_eav, 0.0)


def tav_withdrawal(o, withdrawal_outcome, asked_tav):
    return o.where(withdrawal_outcome == 4, asked_tav, 0.0)


def end_si(o, withdrawal_outcome, asked_end_si, start_si):
    return o.where(withdrawal_outcome == 4, asked_end_si, start_si)


# -- premium loads -----------------------------------------------------------

def unrounded_em_load(
    o, em_load_term_flag, risk_flag, extra_prem_rate, em_load_pct, ben, ep_alloc_chrg_rate
):
    load = extra_prem_rate * em_load_pct * ben / 1000.0 / (1.0 - ep_alloc_chrg_rate)
    return o.where(em_load_term_flag & risk_flag, load, 0.0)


def em_load(o, unrounded_em_load):
    return o.ceil(unrounded_em_load / 1000.0) * 1000.0


def unrounded_pm_load(o, pm_load_term_flag, risk_flag, pm_load_rate, ben, ep_alloc_chrg_rate):
    load = pm_load_rate * ben / 1000.0 / (1.0 - ep_alloc_chrg_rate)
    return o.where(pm_load_term_flag & risk_flag, load, 0.0)


def pm_load(o, unrounded_pm_load):
    return o.ceil(unrounded_pm_load / 1000.0) * 1000.0


def load(o, em_load, pm_load):
    return em_load + pm_load


def load_alloc_chrg(o, load, ep_alloc_chrg_rate):
    return load * ep_alloc_chrg_rate


def load_alloc(o, load, load_alloc_chrg):
    return load - load_alloc_chrg


def alloc_chrg(o, load_alloc_chrg, ep_alloc_chrg, tp_alloc_chrg):
    return load_alloc_chrg + ep_alloc_chrg + tp_alloc_chrg


def alloc(o, load_alloc, ep_alloc, tp_alloc):
    return load_alloc + ep_alloc + tp_alloc


# -- accounts after withdrawal and allocation --------------------------------

def eav_after_wdrl_and_alloc(o, start_eav, eav_withdrawal, ep_alloc, load_alloc):
    return start_eav - eav_withdrawal + ep_alloc + load_alloc


def tav_after_wdrl_and_alloc(o, start_tav, tav_withdrawal, tp_alloc):
    return start_tav - tav_withdrawal + tp_alloc


def pav_after_wdrl_and_alloc(o, eav_after_wdrl_and_alloc, tav_after_wdrl_and_alloc):
    return eav_after_wdrl_and_alloc + tav_after_wdrl_and_alloc


# -- cost of insurance -------------------------------------------------------

def sar(o, option_a, ben, start_pav):
    return o.where(option_a, o.maximum(ben - start_pav, 0.0), ben)


def standard_coi(o, sar, coi_rate):
    return sar * coi_rate


def em_load_coi(o, risk_flag, em_load_pct, standard_coi):
    return o.where(risk_flag, em_load_pct * standard_coi, 0.0)


def pm_load_coi(o, risk_flag, pm_load_rate, sar):
    return o.where(risk_flag, pm_load_rate * sar / 1000.0, 0.0)


def acc_coi(o, acc_ben_term_flag, acc_ben, acc_coi_rate):
    return o.where(acc_ben_term_flag, acc_ben * acc_coi_rate * 12.0, 0.0)


def coi(o, standard_coi, em_load_coi, pm_load_coi, acc_coi):
    return standard_coi + em_load_coi + pm_load_coi + acc_coi


# -- deduction and lapse -----------------------------------------------------

def plan_nom_deduction(o, coi, admin_chrg):
    return coi + admin_chrg * 12.0


def plan_deduction(o, plan_nom_deduction, due_a_n1_m12):
    return plan_nom_deduction * due_a_n1_m12


def deduction_flag(o, cont_flag, plan_deduction, pav_after_wdrl_and_alloc):
    return cont_flag & (plan_deduction <= pav_after_wdrl_and_alloc)


def nom_deduction(o, deduction_flag, plan_nom_deduction):
    return o.where(deduction_flag, plan_nom_deduction, 0.0)


def deduction(o, deduction_flag, plan_deduction):
    return o.where(deduction_flag, plan_deduction, 0.0)


def tav_deduction(o, deduction_flag, tav_after_wdrl_and_alloc, deduction):
    return o.where(deduction_flag, o.minimum(tav_after_wdrl_and_alloc, deduction), 0.0)


def eav_deduction(o, deduction, tav_deduction):
    return deduction - tav_deduction


# -- interest ----------------------------------------------------------------

def eav_int(o, deduction_flag, eav_after_wdrl_and_alloc, eav_deduction, annual_int_rate):
    interest = (eav_after_wdrl_and_alloc - eav_deduction) * annual_int_rate
    return o.where(deduction_flag, interest, 0.0)


def tav_int(o, deduction_flag, tav_after_wdrl_and_alloc, tav_deduction, annual_int_rate):
    interest = (tav_after_wdrl_and_alloc - tav_deduction) * annual_int_rate
    return o.where(deduction_flag, interest, 0.0)


def interest(o, eav_int, tav_int):
    return eav_int + tav_int


# -- bonuses -----------------------------------------------------------------

def lb_reviewed(o, deduction_flag, lb_rate):
    return deduction_flag & (lb_rate > 0.0)


def sb_rate(o, deduction_flag, has_special_bonus, year, sb_year_offset, start_si):
    at = year - 1 + sb_year_offset
    large = start_si >= codes.SPECIAL_BONUS_LARGE_SI
    rate = 0.0
    for step, (standard, high) in codes.SPECIAL_BONUS_RATES.items():
        rate = o.where(at == step, o.where(large, high, standard), rate)
    return o.where(deduction_flag & has_special_bonus, rate, 0.0)


def lb_flag(o, lb_reviewed, lb_tav_withdrawal_review):
    return lb_reviewed & (lb_tav_withdrawal_review == 0.0)


def lb(o, lb_flag, lb_rate, tp_1):
    return o.where(lb_flag, lb_rate * tp_1, 0.0)


def sb_flag(o, sb_rate, sb_tav_withdrawal_review):
    return (sb_rate > 0.0) & (sb_tav_withdrawal_review == 0.0)


def sb(o, sb_flag, sb_rate, tp_1):
    return o.where(sb_flag, sb_rate * tp_1, 0.0)


def bonus(o, lb, sb):
    return lb + sb


# -- values at the end of the year -------------------------------------------

def end_eav(o, deduction_flag, eav_after_wdrl_and_alloc, eav_deduction, eav_int):
    return o.where(deduction_flag, eav_after_wdrl_and_alloc - eav_deduction + eav_int, 0.0)


def end_tav(o, deduction_flag, tav_after_wdrl_and_alloc, tav_deduction, tav_int, bonus):
    value = tav_after_wdrl_and_alloc - tav_deduction + tav_int + bonus
    return o.where(deduction_flag, value, 0.0)


def end_pav(o, end_eav, end_tav):
    return end_eav + end_tav


# Formulas in layers: a layer uses inputs and earlier layers only.
PREMIUM_LAYERS = (
    (tp_term_flag, ep_term_flag),
    (tp, ep),
    (srr_chrg, tp_alloc_chrg, ep_alloc_chrg),
    (tp_alloc, ep_alloc),
)
ACCOUNT_LAYERS = (
    (start_pav,),
    (srr_val, ben, acc_ben, asked_eav, asked_end_si),
    (asked_tav, unrounded_em_load, unrounded_pm_load, sar),
    (asked_end_pav, em_load, pm_load, standard_coi, pm_load_coi, acc_coi),
    (withdrawal_outcome, load, em_load_coi),
    (withdrawal, eav_withdrawal, tav_withdrawal, end_si, load_alloc_chrg, coi),
    (load_alloc, alloc_chrg, plan_nom_deduction, tav_after_wdrl_and_alloc),
    (alloc, eav_after_wdrl_and_alloc, plan_deduction),
    (pav_after_wdrl_and_alloc,),
    (deduction_flag,),
    (nom_deduction, deduction, lb_reviewed, sb_rate),
)
END_LAYERS = (
    (tav_deduction, lb_flag, sb_flag),
    (eav_deduction, tav_int, lb, sb),
    (eav_int, bonus),
    (interest, end_eav, end_tav),
    (end_pav,),
)


def inputs_of(formula) -> list[str]:
    return list(inspect.signature(formula).parameters)[1:]


def add_layers(frame: DataFrame, layers) -> DataFrame:
    """Each layer as one projection, so a shared result is computed once."""
    for layer in layers:
        frame = frame.select("*", *[
            f(ColumnOps, *[F.col(name) for name in inputs_of(f)]).alias(f.__name__)
            for f in layer
        ])
    return frame


def needed(layers, results: set[str]):
    """The formulas of ``layers``, in order, that ``results`` depend on."""
    wanted, kept = set(results), []
    for formula in reversed([f for layer in layers for f in layer]):
        if formula.__name__ in wanted:
            kept.append((formula.__name__, formula, inputs_of(formula)))
            wanted.update(inputs_of(formula))
    return kept[::-1]


def evaluate(formulas, values: dict) -> None:
    """Run formulas from :func:`needed` on arrays, adding results to ``values``."""
    for name, formula, inputs in formulas:
        values[name] = formula(ArrayOps, *[values[i] for i in inputs])
