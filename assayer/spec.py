"""Role description of a table, and the fixed values of the scoring rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Placeholder tokens, compared after lower-casing and accent removal.
MISSING_TOKENS = ("", "no definido", "n/a", "na", "null", "none")
NOT_APPLICABLE_TOKENS = ("no aplica",)
NOT_YET_TOKENS = ("no adjudicado",)
UNKNOWN_TOKENS = ("no especificado",)
PLACEHOLDER_TOKENS = MISSING_TOKENS + NOT_APPLICABLE_TOKENS + NOT_YET_TOKENS + UNKNOWN_TOKENS

# Placeholder phrases the scoring rules reject (full match, lower case).
SCORING_PLACEHOLDER = (
    r"^(?:|n/?a|na|null|none|sin\s+informacion|sin\s+definir|no\s+aplica|no\s+definid[oa]|no\s+registrado)$"
)

# Labels written in place of preserved placeholders.
NOT_APPLICABLE_LABEL = "NO_APLICA"
UNKNOWN_UNIT_LABEL = "UNIDAD_DESCONOCIDA"

# Spellings of a duration unit (ASCII, lower case), its canonical name and its days.
DURATION_UNITS = {
    "día(s)": (("dia(s)", "dias", "dia"), 1.0),
    "Mes(es)": (("mes(es)", "mes", "meses"), 30.0),
    "Año(s)": (("ano(s)", "ano", "anos"), 365.0),
    "Hora(s)": (("hora(s)", "hora", "horas"), 1.0 / 24.0),
    "Semana(s)": (("semana(s)", "semana", "semanas"), 7.0),
}

# Sub-score weights, summed in this order.
COMPLETENESS_WEIGHTS = {
    "flag_useful_description": 0.30,
    "flag_has_category": 0.20,
    "flag_has_price": 0.20,
    "flag_has_place": 0.15,
    "flag_has_type_and_mode": 0.15,
}
TRACEABILITY_WEIGHTS = {
    "flag_valid_id": 0.35,
    "flag_valid_reference": 0.25,
    "flag_public_url": 0.25,
    "flag_has_portfolio": 0.15,
}
TEMPORAL_WEIGHTS = {
    "flag_dates_available": 0.25,
    "flag_published_before_received": 0.30,
    "flag_received_before_opened": 0.20,
    "flag_receipt_window_ok": 0.15,
    "flag_opening_window_ok": 0.10,
}
COMPETITION_WEIGHTS = {
    "flag_competition_data": 0.20,
    "flag_participation": 0.30,
    "flag_minimal_competition": 0.35,
    "competition_intensity": 0.15,
}
TOTAL_WEIGHTS = {
    "score_completeness": 0.30,
    "score_traceability": 0.25,
    "score_temporal": 0.25,
    "score_competition": 0.20,
}
DUPLICATE_PENALTY = 0.35

# Thresholds.
RISK_THRESHOLD = 0.65
HIGH_RISK_THRESHOLD = 0.50
MIN_DESCRIPTION_LENGTH = 20
MIN_REFERENCE_LENGTH = 5
RECEIPT_WINDOW_DAYS = 90
OPENING_WINDOW_DAYS = 30
COMPETITION_SATURATION = 10
PRICE_QUANTILE = 0.995
PRICE_MIN_GROUP = 50
DURATION_QUANTILE = 0.999
DURATION_FLOOR_DAYS = 3650.0
HIGH_NULL_PCT = 30.0
NEAR_CONSTANT_PCT = 95.0
RARE_SHARE = 0.01
SHORT_TEXT = 10
LARGE_SAMPLE = 5000
MIN_NON_NULL_PCT = 60.0
MIN_NUMERIC_LEVELS = 5
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """Which column plays which role. A role left empty is simply not computed."""

    id: str
    reference: str | None = None
    portfolio: str | None = None
    url: str | None = None
    description: str | None = None
    category: str | None = None
    price: str | None = None
    price_group: str | None = None
    mode: str | None = None
    type: str | None = None
    places: tuple[str, ...] = ()
    state: str | None = None
    published: str | None = None
    received: str | None = None
    opened: str | None = None
    effective: str | None = None
    latest: str | None = None
    duration: str | None = None
    duration_unit: str | None = None
    multi_value: str | None = None
    direct_responses: str | None = None
    responses: tuple[str, ...] = ()
    invited: tuple[str, ...] = ()
    suppliers: str | None = None
    ratio_denominator: str | None = None
    counters: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    keep_not_applicable: tuple[str, ...] = ()
    critical: tuple[str, ...] = ()
    leakage: tuple[str, ...] = ()
    low_variability: tuple[str, ...] = ()
    redundant: tuple[str, ...] = ()
    almost_empty: tuple[str, ...] = ()
    traceability: tuple[str, ...] = ()
    tie_break: tuple[str, ...] = ()
    extra_dates: tuple[str, ...] = ()
    id_pattern: str = r"^CO\d+\.[A-Z0-9_]+\.[A-Z0-9._-]+$"
    url_pattern: str = r"^https?://.+$"
    options: dict = field(default_factory=dict, compare=False)

    @property
    def dates(self) -> tuple[str, ...]:
        named = (self.published, self.received, self.opened, self.effective, self.latest)
        return tuple(dict.fromkeys(c for c in (*named, *self.extra_dates) if c))

    @property
    def competition(self) -> tuple[str, ...]:
        named = (*self.responses, *self.invited, self.suppliers)
        return tuple(dict.fromkeys(c for c in named if c))

    @property
    def numeric(self) -> tuple[str, ...]:
        named = (self.price, self.duration, *self.counters, *self.competition)
        return tuple(dict.fromkeys(c for c in named if c))

    @property
    def dropped(self) -> tuple[str, ...]:
        groups = (self.leakage, self.low_variability, self.redundant, self.almost_empty)
        return tuple(dict.fromkeys(c for group in groups for c in group))

    def required(self) -> tuple[str, ...]:
        """Columns the scoring contract asks for."""
        named = (
            self.id, self.reference, self.portfolio, self.description, self.category, self.price,
            *self.places, self.mode, self.type, self.url, self.published, self.received, self.opened,
            *self.competition,
        )
        return tuple(dict.fromkeys(c for c in named if c))

    def with_(self, **changes) -> "Spec":
        return replace(self, **changes)


def procurement_spec(url_host: str = r"[^/]+") -> Spec:
    """Preset for the public-procurement table with its published Spanish column names."""
    # Column names of the open-data table.
    return Spec(
        id="id_del_proceso",
        reference="referencia_del_proceso",
        portfolio="id_del_portafolio",
        url="urlproceso",
        description="descripci_n_del_procedimiento",
        category="codigo_principal_de_categoria",
        price="precio_base",
        price_group="tipo_de_contrato",
        mode="modalidad_de_contratacion",
        type="tipo_de_contrato",
        places=("departamento_entidad", "ciudad_entidad"),
        state="estado_del_procedimiento",
        published="fecha_de_publicacion_del",
        received="fecha_de_recepcion_de",
        opened="fecha_de_apertura_de_respuesta",
        effective="fecha_de_apertura_efectiva",
        latest="fecha_de_ultima_publicaci",
        duration="duracion",
        duration_unit="unidad_de_duracion",
        multi_value="categorias_adicionales",
        direct_responses="respuestas_al_procedimiento",
        responses=("respuestas_al_procedimiento", "respuestas_externas", "conteo_de_respuestas_a_ofertas"),
        invited=("proveedores_con_invitacion",),
        suppliers="proveedores_unicos_con",
        ratio_denominator="proveedores_invitados",
        counters=(
            "visualizaciones_del", "proveedores_invitados", "proveedores_con_invitacion",
            "respuestas_al_procedimiento", "respuestas_externas", "conteo_de_respuestas_a_ofertas",
            "proveedores_unicos_con", "numero_de_lotes",
        ),
        text=(
            "entidad", "departamento_entidad", "ciudad_entidad", "ordenentidad", "codigo_pci",
            "id_del_proceso", "referencia_del_proceso", "id_del_portafolio", "nombre_del_procedimiento",
            "fase", "modalidad_de_contratacion", "justificaci_n_modalidad_de", "nombre_de_la_unidad_de",
            "tipo_de_contrato", "codigo_principal_de_categoria", "codigo_entidad", "nit_entidad",
            "descripci_n_del_procedimiento", "ciudad_de_la_unidad_de", "subtipo_de_contrato",
        ),
        keep_not_applicable=("ciudad_de_la_unidad_de",),
        critical=(
            "entidad", "codigo_entidad", "fecha_de_publicacion_del", "nombre_del_procedimiento",
            "descripci_n_del_procedimiento", "precio_base", "modalidad_de_contratacion",
            "tipo_de_contrato", "urlproceso",
        ),
        leakage=(
            "estado_del_procedimiento", "id_estado_del_procedimiento", "estado_de_apertura_del_proceso",
            "estado_resumen", "fecha_adjudicacion", "fecha_de_ultima_publicaci", "fecha_de_apertura_efectiva",
        ),
        low_variability=("subtipo_de_contrato", "proveedores_que_manifestaron"),
        redundant=("ppi", "fecha_de_publicacion_fase_3"),
        almost_empty=("fecha_de_publicacion_fase", "fecha_de_publicacion_fase_2", "fecha_de_publicacion"),
        traceability=("id_del_proceso", "referencia_del_proceso", "id_del_portafolio", "urlproceso"),
        tie_break=("fecha_de_ultima_publicaci",),
        extra_dates=(
            "fecha_de_publicacion_fase", "fecha_de_publicacion_fase_2", "fecha_de_publicacion_fase_3",
            "fecha_de_publicacion", "fecha_adjudicacion",
        ),
        url_pattern=rf"^https?://{url_host}/public/tendering/opportunitydetail/index\?noticeuid=.+$",
    )
