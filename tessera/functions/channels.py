"""Families of logs by their channels' names, and what a channel means in its family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import cylinder

# fixed values: family, signal, and the channels that carry it
ALIASES = """
BmwMedc17|EngineRpm|Epm_nEng
BmwMedc17|EngineTorque|mkist_w_msg, ActMod_trqClth, ActMod_trqClthWoDstC, ActMod_trq
BmwMedc17|IntakeManifoldPressure|ps_w_msg
BmwMedc17|BoostSetpoint|psolldr_w_msg, rlsol_w_msg
BmwMedc17|LambdaActual|UEGO_rLamS1B1, lamsoni_w_msg
BmwMedc17|LambdaTarget|lamsons_w_msg, lamsbg_w_msg
BmwMedc17|LambdaController|fr_w_msg
BmwMedc17|IntakeAirTemp|tans_msg, tans
BmwMedc17|CoolantTemp|tmot_msg, tmot
BmwMedc17|OilTemp|toel_msg
BmwMedc17|OilPressure|poel_w_msg
BmwMedc17|ThrottlePosition|wdks_msg, wdkba_msg, tvldste_w_msg
BmwMedc17|RailPressureActual|FuPHi_pRail, prist_w_msg, RailP_pCurr
BmwMedc17|RailPressureSetpoint|FuPHi_pRailSp, prsoll_w_msg, Rail_pSetPoint, PCR_pDesVal
BmwMedc17|IgnitionTimingOut|zwsol_msg, zwoutakt_msg
BmwMedc17|KnockRetardCyl|BasSvrAppl_AusZun_msg, Zuendwinkelspaetverstellung_HWZyl
BmwMedc17|WastegatePos|SwSABMW_ratPosWgeTst
BmwMedc17|MassAirFlow|ml_msg
BmwMedc17|RelativeLoad|rl_msg
BmwMedc17|Gear|gangi_msg
BmwMedc17|ExhaustGasTemp|ExhMod_tExhS2B1, Exh_tAdapTOxiCatUs
BoschMercME|EngineRpm|nmot_w
BoschMercME|EngineTorque|Eng_Trq, gentrq_w
BoschMercME|BoostSetpoint|pvds_w
BoschMercME|IntakeManifoldPressure|pvd_w
BoschMercME|LambdaActual|lamsoni_w
BoschMercME|LambdaTarget|lamsons_w, Lambda_Sollwert_Links
BoschMercME|LambdaController|fr_w, Lambdaregelwert_Links
BoschMercME|IntakeAirTemp|tans
BoschMercME|CoolantTemp|tmot
BoschMercME|ThrottlePosition|wdkba, tvldste_w
BoschMercME|RailPressureActual|prist_w
BoschMercME|RailPressureSetpoint|prsoll_w
BoschMercME|IgnitionTimingOut|zwout
BoschMercME|KnockRetardCyl|Zuendwinkelspaetverstellung_HWZyl, wkrmv
BoschMercME|RelativeLoad|rl_w
PorscheSdi21|EngineRpm|EnginRPM
PorscheSdi21|EngineTorque|EnginTorqu
PorscheSdi21|IntakeManifoldPressure|IntakManifAirPressCommaValue, IntakManifAirPressCorreValue, BoostPress
PorscheSdi21|BoostSetpoint|BoostPressActuaCommaValue, BoostPressCommaValue
PorscheSdi21|LambdaActual|UEGORLamS1B1
PorscheSdi21|LambdaTarget|FuelAirCommaEquivRatio
PorscheSdi21|IntakeAirTemp|IntakManifAirTempeRawValue, IntakManifAirTempeMeasuRawValue
PorscheSdi21|CoolantTemp|EnginCoolaTempe
PorscheSdi21|ThrottlePosition|RelatThrotPosit, ThrotActuaActuaValuePerce
PorscheSdi21|RailPressureActual|FuelHighPressActuaValue
PorscheSdi21|RailPressureSetpoint|FuelHighPressCommaValue
PorscheSdi21|IgnitionTimingOut|IgnitTiminAdvanFor1Cylin
PorscheSdi21|KnockRetardCyl|IgnitAdvanReducCylin
PorscheSdi21|MassAirFlow|AirMassRatedValue, IntakManifModelAirMassFlowFilteValue
PorscheSdi21|RelativeLoad|LoadValueRelat, LoadValueCorreCommaValue
PorscheOldSdi|EngineRpm|n
PorscheOldSdi|EngineTorque|tq_av, tqi_av
PorscheOldSdi|IntakeManifoldPressure|prs_im_mes, prs_im_mdl
PorscheOldSdi|BoostSetpoint|prs_im_sp
PorscheOldSdi|ThrottlePosition|pwm_etc
PorscheOldSdi|WastegatePos|PWM_TUR_ACR, PWM_TUR_ACR_SP
PorscheOldSdi|IntakeAirTemp|tia
PorscheOldSdi|OilTemp|toil_sens
PorscheOldSdi|Gear|gear
MercedesMeBlock|EngineRpm|Block031[Motordrehzahl], Motordrehzahl
MercedesMeBlock|EngineTorque|Block029[TQI_AV]
MercedesMeBlock|IntakeManifoldPressure|PUT_MES, Ladedruck, MAP_MES, Block003[Saugrohrdruck]
MercedesMeBlock|BoostSetpoint|Ladedruck_Soll
MercedesMeBlock|MassAirFlow|Block019[MAF_KGH_MES]
MercedesMeBlock|WastegatePos|PWM_WG
MercedesMeBlock|IntakeAirTemp|TIA
MercedesMeBlock|IgnitionTimingOut|Zuendwinkel
MercedesMeBlock|KnockRetardCyl|Zuendwinkelspaetverstellung_HWZyl
BmwMssS55|EngineRpm|nmot
BmwMssS55|EngineTorque|mkist_w
BmwMssS55|IntakeManifoldPressure|ps_w
BmwMssS55|BoostSetpoint|psolldr_w
BmwMssS55|LambdaActual|lamsoni_w
BmwMssS55|LambdaTarget|lamsons_w
BmwMssS55|LambdaController|fr_w
BmwMssS55|IntakeAirTemp|tans
BmwMssS55|CoolantTemp|tmot
BmwMssS55|ThrottlePosition|wdk1, tvldste_w
BmwMssS55|RailPressureActual|prist_w
BmwMssS55|RailPressureSetpoint|prsoll_w
BmwMssS55|IgnitionTimingOut|zwzyl1, zwoutzyl_w
BmwMssS55|KnockRetardCyl|zwoutzyln_w
BmwMssS55|MassAirFlow|ml
BmwMssS55|RelativeLoad|rl
Autotuner|EngineRpm|engine speed
Autotuner|EngineTorque|engine torque
Autotuner|EngineTorqueSetpoint|engine torque setpoint
Autotuner|IntakeManifoldPressure|boost pressure
Autotuner|BoostSetpoint|boost pressure setpoint
Autotuner|AmbientPressure|ambient pressure
Autotuner|LambdaActual|lambda (afr), lambda
Autotuner|LambdaTarget|lambda (afr) setpoint, lambda (afr) bank 1 setpoint, lambda setpoint, lambda target
Autotuner|IntakeAirTemp|intake air temperature
Autotuner|CoolantTemp|engine temperature, coolant temperature
Autotuner|OilTemp|engine oil temperature, oil temperature
Autotuner|OilPressure|oil pressure
Autotuner|ThrottlePosition|throttle valve position
Autotuner|AcceleratorPedal|gaspedal position, accelerator pedal position
Autotuner|RailPressureActual|fuel high pressure
Autotuner|RailPressureSetpoint|fuel high pressure setpoint
Autotuner|FuelLowPressureSetpoint|fuel low pressure setpoint
Autotuner|InjectionDuration|injection duration
Autotuner|LongTermFuelTrim|long term fuel trim
Autotuner|ShortTermFuelTrim|short term fuel trim
Autotuner|IgnitionTimingOut|ignition advance
Autotuner|KnockRetardCyl|ignition withdrawal timing
Autotuner|KnockFlag|knock detected
Autotuner|MisfireCounter|misfire counter
Autotuner|MassAirFlow|mass air flow
Autotuner|MassAirFlowSetpoint|mass air flow setpoint
Autotuner|RelativeLoad|load actual, relative load
Autotuner|ExhaustGasTemp|exhaust gas temperature before catalyst, exhaust gas temperature
Autotuner|VehicleSpeed|vehicle speed
Autotuner|Gear|gear
Autotuner|WastegatePos|wastegate duty cycle, wastegate position
"""

# fixed values: a family by channels that a log has all of, in order of precedence
FAMILIES = [("Autotuner", ("Engine speed",)), ("Autotuner", ("Gaspedal position",)), ("PorscheSdi21", ("EnginRPM",)), ("BmwMedc17", ("Epm_nEng",)), ("BoschMercME", ("nmot_w",)), ("BmwMssS55", ("nmot",)), ("PorscheOldSdi", ("gear", "n")), ("MercedesMeBlock", ("Motordrehzahl",))]


def _table() -> dict[tuple[str, str], str]:
    rows = (line.split("|") for line in ALIASES.strip().splitlines())
    return {(family, name): signal for family, signal, names in rows for name in names.split(", ")}


def family(names: Column) -> Column:
    """The family of a log by the array of its channels' names; ``Unknown`` if no rule fits, null for null."""
    out = F.when(names.isNotNull(), "Unknown")
    for label, needed in reversed(FAMILIES):
        fits = F.forall(F.array(*map(F.lit, needed)), lambda n: F.array_contains(names, n))
        if label == "MercedesMeBlock":
            fits = fits | F.exists(names, lambda n: n.startswith("Block"))
        out = F.when(fits, label).otherwise(out)
    return out


def families(samples: DataFrame) -> DataFrame:
    """``log_id, family`` of samples (log_id, channel); the distinct names of a log are few."""
    return samples.groupBy("log_id").agg(family(F.collect_set("channel")).alias("family"))


def signal(name: Column, of: Column) -> Column:
    """``signal, cylinder`` of a channel in its family; in the family ``Unknown`` the first family to know it.

    A name goes without its cylinder number, which only knock retards keep.
    """
    table = F.create_map(*(F.lit(x) for (f, n), s in _table().items() for x in (f"{f}|{n}", s)))
    parts = cylinder(name)
    look = lambda f, n: F.try_element_at(table, F.concat(f, F.lit("|"), n))
    base = parts["channel"]
    own = F.when(of == "Autotuner", F.lower(base)).otherwise(base)
    order = dict.fromkeys(f for f, _ in _table())
    anywhere = F.coalesce(*(look(F.lit(f), F.lower(base) if f == "Autotuner" else base) for f in order))
    found = F.when(name == "Time", "Time").when(of == "Unknown", anywhere).otherwise(look(of, own))
    return F.struct(F.coalesce(found, F.lit("Unknown")).alias("signal"), F.when(found == "KnockRetardCyl", parts["cylinder"]).alias("cylinder"))
