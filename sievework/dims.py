"""Controlled vocabularies of the audit.

Everything in this module is a fixed value: names, codes, labels and numbers
that decide what a result looks like.  All tables are closed and small (under
200 rows), so they are used as literals inside expressions (``isin``, literal
maps) rather than as joined tables; nothing here grows with the audited data.
"""

from __future__ import annotations

# --- Fixed values: fetch outcome -------------------------------------------
FETCH_STATUSES = (
    "downloaded", "truncated", "service", "too_large", "no_url",
    "error", "http_error", "unreachable",
)
FETCH_DELIVERED = ("downloaded", "truncated")
FETCH_NOT_EVALUATED = ("too_large", "no_url", "error")
FETCH_SERVICE = "service"

# --- Fixed values: delivery states -----------------------------------------
DELIVERY_STATES = ("ok", "roto", "no-entrega", "omitida", "no-analizado")
UNEVALUATED_STATES = ("omitida", "no-analizado")

# --- Fixed values: issue code sets -----------------------------------------
NOT_A_FILE_CODES = ("no-es-archivo", "no-es-imagen")
LIMITATION_CODES = (
    "dependencia-faltante", "fallo-analizador", "error-validacion",
    "descarga-truncada", "too_large", "paquete-desproporcionado",
)
BLOCKING_CODES = (
    "descarga", "error-fuente", "no-es-archivo", "archivo-vacio",
    "servicio-no-disponible", "servicio-error", "no-es-imagen",
    "formato-no-esperado", "json-invalido", "xml-no-bien-formado",
    "xlsx-invalido", "zip-invalido", "tipo-no-identificado",
    "error-validacion", "error-esquema", "ical-invalido", "firma-invalida",
    "geojson-invalido", "raiz-invalida", "imagen-corrupta", "shp-faltante",
    "zip-extraccion", "shp-lectura",
)
UNREADABLE_CODES = tuple(sorted({*BLOCKING_CODES, *LIMITATION_CODES, *NOT_A_FILE_CODES}))
HIGH_IMPACT_CODES = (
    "error-tipo", "celda-extra", "fila-vacia", "encabezado-vacio",
    "encabezado-duplicado", "fila-duplicada", "error-restriccion",
    "error-unico", "error-encoding", "xls-legado", "tipo-detectado",
    "sin-datos", "sin-contenido", "geometria-nula",
)
MISSING_CELL_ALERT = 1000
CODES_WITH_CELL_VALUE = (
    "error-tipo", "encabezado-duplicado", "encabezado-vacio", "celda-extra",
    "error-restriccion", "error-unico", "fila-duplicada",
)

# --- Fixed values: issue code -> category ----------------------------------
AVAILABILITY_CODES = (
    "descarga", "error-fuente", "no-es-archivo", "archivo-vacio",
    "servicio-no-disponible", "servicio-error",
)
FORMAT_CODES = (
    "formato-no-esperado", "json-invalido", "xml-no-bien-formado",
    "xlsx-invalido", "zip-invalido", "xml-reparado", "error-encoding",
    "tipo-detectado", "tipo-no-identificado", "xls-legado", "error-esquema",
    "ical-invalido", "firma-invalida", "geojson-invalido", "raiz-invalida",
    "shp-faltante", "zip-extraccion", "shp-lectura", "no-es-imagen",
)
CATEGORY_LABELS = {
    "availability": "Disponibilidad",
    "format": "Conformidad del formato",
    "content": "Calidad de contenido",
    "portal": "Limitación de este portal",
}

# --- Fixed values: structural check -> (issue code, severity) --------------
STRUCTURAL_CHECKS = {
    "type-error": ("error-tipo", "error"),
    "missing-cell": ("celda-faltante", "warning"),
    "blank-row": ("fila-vacia", "error"),
    "extra-cell": ("celda-extra", "error"),
    "blank-label": ("encabezado-vacio", "error"),
    "duplicate-label": ("encabezado-duplicado", "error"),
    "duplicate-row": ("fila-duplicada", "warning"),
    "source-error": ("error-fuente", "error"),
    "schema-error": ("error-esquema", "error"),
    "constraint-error": ("error-restriccion", "error"),
    "unique-error": ("error-unico", "error"),
    "encoding-error": ("error-encoding", "error"),
}

# --- Fixed values: scoring -------------------------------------------------
COMPOSITE_WEIGHTS = {"metadata": 0.4, "availability": 0.3, "content": 0.3}
METADATA_WEIGHTS = {"completeness": 0.4, "formats": 0.25, "freshness": 0.25, "license": 0.1}
SCORE_OK = 80
SCORE_WARN = 50
SCORE_LEVEL_LABELS = {"ok": "Buena", "warn": "Mejorable", "bad": "Deficiente"}
DATASET_STATUS = {"ok": "healthy", "warn": "warning", "bad": "critical"}
DAYS_PER_MONTH = 30.44

# --- Fixed values: cell typing ---------------------------------------------
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DECIMAL_COMMA_PATTERN = r"^[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+),[0-9]+$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TYPE_RANK = {"number": 0, "date": 1, "bool": 2, "str": 3, "any": 4}
TYPE_DISPLAY = {"number": "number", "date": "date", "bool": "boolean"}  # else "string"
MIN_VALUES_FOR_TYPE = 3
MIN_FILL = 0.5
MAX_CELL_CHARS = 1000
SAMPLE_ROWS = 200
MAX_OCCURRENCES = 2_000_000

# --- Fixed values: formats -------------------------------------------------
GEO_FORMATS = ("SHP", "KML", "GML", "WMS", "WFS", "GeoJSON", "ECW")
OPEN_FORMATS = ("CSV", "JSON", "GeoJSON")
SERVICE_FORMATS = ("WMS", "WFS")
MIME_TO_FORMAT = {
    "text/csv": "CSV",
    "application/json": "JSON",
    "application/geo+json": "GeoJSON",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "application/x-zipped-shp": "SHP",
    "application/xml": "XML",
    "application/rdf+xml": "RDF",
    "application/rss+xml": "RSS",
    "application/vnd.google-earth.kml+xml": "KML",
    "application/gml+xml": "GML",
    "text/wms": "WMS",
    "text/wfs": "WFS",
    "text/plain": "TXT",
    "image/jpeg": "JPEG",
    "text/calendar": "iCal",
    "application/ecw": "ECW",
    "application/octet-stream": "BIN",
}
DEFAULT_FORMAT = "OTRO"
FORMAT_OPENNESS = {
    "CSV": 100, "JSON": 100, "GeoJSON": 100, "RDF": 85, "RSS": 80, "KML": 80,
    "GML": 80, "XLSX": 80, "WMS": 70, "WFS": 70, "iCal": 70, "SHP": 60,
    "TXT": 60, "JPEG": 30, "ECW": 20, "BIN": 10, "OTRO": 40,
}
DEFAULT_OPENNESS = 40

# --- Fixed values: licences (first pattern that matches wins) --------------
LICENSE_PATTERNS = (
    (r"(?i)creativecommons\.org/licenses/by-sa/4\.0", "CC-BY-SA-4.0"),
    (r"(?i)creativecommons\.org/licenses/by/4\.0", "CC-BY-4.0"),
    (r"(?i)creativecommons\.org/publicdomain/zero/1\.0", "CC0"),
    (r"(?i)opendatacommons\.org/licenses/odbl", "ODbL"),
    (r"(?i)igcyl", "IGCYL-NC"),
)
DEFAULT_LICENSE = "Otro"
LICENSE_POINTS = {"CC-BY-4.0": 100, "IGCYL-NC": 55}
DEFAULT_LICENSE_POINTS = 60

# --- Fixed values: theme URI -> category -----------------------------------
THEME_PREFIX = "http://datos.gob.es/kos/sector-publico/sector/"
THEME_CATEGORIES = {
    "medio-ambiente": "Medio Ambiente",
    "energia": "Medio Ambiente",
    "medio-rural-pesca": "Medio Ambiente",
    "transporte": "Transporte",
    "economia": "Economía",
    "empleo": "Economía",
    "comercio": "Economía",
    "industria": "Economía",
    "hacienda": "Economía",
    "salud": "Salud",
    "educacion": "Educación",
    "cultura-ocio": "Cultura",
    "turismo": "Cultura",
    "deporte": "Cultura",
    "demografia": "Demografía",
    "sector-publico": "Servicios Públicos",
    "sociedad-bienestar": "Servicios Públicos",
    "seguridad": "Servicios Públicos",
    "legislacion-justicia": "Servicios Públicos",
    "urbanismo-infraestructuras": "Servicios Públicos",
    "ciencia-tecnologia": "Servicios Públicos",
}
DEFAULT_CATEGORY = "Otros"

# --- Fixed values: theme and territory labels ------------------------------
THEME_LABELS = {
    "ciencia-tecnologia": "Ciencia y tecnología",
    "comercio": "Comercio",
    "cultura-ocio": "Cultura y ocio",
    "demografia": "Demografía",
    "deporte": "Deporte",
    "economia": "Economía",
    "educacion": "Educación",
    "empleo": "Empleo",
    "energia": "Energía",
    "hacienda": "Hacienda",
    "industria": "Industria",
    "legislacion-justicia": "Legislación y justicia",
    "medio-ambiente": "Medio ambiente",
    "medio-rural-pesca": "Medio rural y pesca",
    "salud": "Salud",
    "sector-publico": "Sector público",
    "seguridad": "Seguridad",
    "sociedad-bienestar": "Sociedad y bienestar",
    "transporte": "Transporte",
    "turismo": "Turismo",
    "urbanismo-infraestructuras": "Urbanismo e infraestructuras",
    "vivienda": "Vivienda",
    "medio-rural": "Medio rural",
}
TERRITORY_LABELS = {
    "castilla-leon": "Castilla y León",
    "avila": "Ávila",
    "burgos": "Burgos",
    "leon": "León",
    "palencia": "Palencia",
    "salamanca": "Salamanca",
    "segovia": "Segovia",
    "soria": "Soria",
    "valladolid": "Valladolid",
    "zamora": "Zamora",
    "espana": "España",
}
PERIODICITY_LABELS = {1: "mensual", 3: "trimestral", 6: "semestral", 12: "anual"}

# --- Fixed values: issue and fetch-status labels ---------------------------
DEFAULT_ISSUE_LABEL = "Incidencia sin descripción"
ISSUE_LABELS = {
    "http_error": "El servidor respondió con un error",
    "unreachable": "No se pudo contactar con el servidor",
    "service": "Servicio de mapas: se comprueba consultándolo, no descargando un archivo",
    "too_large": "Supera el tamaño máximo que este portal descarga",
    "downloaded": "El archivo se descargó completo",
    "truncated": "El archivo se descargó solo en parte",
    "no_url": "El catálogo no publica ninguna URL de acceso",
    "error": "Fallo interno del análisis de este portal",
    "celda-faltante": "Celdas vacías en filas con datos",
    "error-tipo": "Valores que no encajan con el tipo de su columna",
    "encabezado-vacio": "Encabezados de columna vacíos",
    "fila-vacia": "Filas completamente vacías",
    "celda-extra": "Celdas de más (filas más largas que el encabezado)",
    "encabezado-duplicado": "Encabezados de columna duplicados",
    "fila-duplicada": "Filas duplicadas",
    "error-restriccion": "Valores fuera de lo que admite su columna",
    "error-unico": "Valores repetidos en una columna que no debería repetirlos",
    "error-esquema": "No se ha podido deducir la estructura de las columnas",
    "zip-invalido": "El archivo comprimido (ZIP) está dañado",
    "servicio-error": "El servicio de origen rechaza la descarga del archivo",
    "descarga-truncada": "Comprobado solo en parte: la descarga se cortó por tamaño",
    "paquete-desproporcionado": "No comprobado: el comprimido se expande muy por encima del tope",
    "json-invalido": "El archivo JSON no se puede leer",
    "xlsx-invalido": "El archivo Excel no se puede abrir",
    "formato-no-esperado": "El contenido no coincide con el formato declarado",
    "xml-no-bien-formado": "El archivo XML tiene errores de estructura",
    "archivo-vacio": "El archivo se descarga vacío (0 bytes)",
    "error-encoding": "Los acentos y las eñes llegan corrompidos",
    "no-es-archivo": "La URL no devuelve un archivo",
    "error-fuente": "El servidor de origen devolvió un error",
    "xml-reparado": "El XML tenía errores que se han corregido al leerlo",
    "descarga": "Error de descarga",
    "fallo-analizador": "Fallo interno del análisis de este portal",
    "tipo-detectado": "El contenido no coincide con el formato anunciado",
    "tipo-no-identificado": "No se ha podido identificar qué tipo de archivo es",
    "xls-legado": "Se anuncia como XLSX pero es un Excel antiguo (.xls)",
    "dependencia-faltante": "Este portal no dispone de lector para este formato",
    "error-validacion": "La comprobación de la estructura no se pudo completar",
    "servicio-no-disponible": "El servicio de mapas no responde",
    "no-es-imagen": "El contenido descargado no es una imagen",
    "sin-datos": "El archivo no contiene ninguna fila de datos",
    "sin-contenido": "El archivo no tiene contenido",
    "sin-entidades": "El documento no contiene ningún registro",
    "sin-eventos": "El calendario no contiene eventos",
    "errores-linea": "Líneas mal formadas que se han descartado al leer",
    "sin-capas": "El servicio de mapas no ofrece ninguna capa",
    "sin-feature-types": "El servicio de mapas no ofrece ninguna capa de datos",
    "imagen-corrupta": "La imagen está dañada y no se puede abrir",
    "firma-invalida": "El contenido no es del tipo que anuncia el archivo",
    "geojson-invalido": "El archivo GeoJSON no cumple la especificación",
    "raiz-invalida": "El documento no tiene la estructura esperada",
    "tipo-desconocido": "El GeoJSON usa un tipo de geometría no reconocido",
    "geometria-nula": "Elementos sin ubicación en el mapa",
    "sin-features": "El archivo no contiene ningún elemento geográfico",
    "sin-prj": "El mapa no dice en qué sistema de coordenadas está (falta el .prj)",
    "shp-faltante": "El ZIP no contiene el mapa (.shp) que debería",
    "zip-extraccion": "El ZIP no se ha podido descomprimir",
    "shp-lectura": "El mapa (shapefile) no se ha podido leer",
    "ical-invalido": "El calendario no se puede leer",
}

# --- Fixed values: what to do about an issue --------------------------------
CONTENT_ACTIONS = {
    "error-tipo":
        "Revisar la columna afectada: normalmente es un total, un «N/D» o una nota de pie colada en una columna numérica o de fecha.",
    "encabezado-vacio":
        "Poner nombre a todas las columnas de la primera fila. Una columna sin nombre rompe la carga automática.",
    "encabezado-duplicado":
        "Renombrar las columnas repetidas para que cada una tenga un nombre único.",
    "fila-vacia":
        "Eliminar las filas en blanco, habituales al exportar desde una hoja de cálculo.",
    "celda-extra":
        "Cuadrar el número de celdas de cada fila con el encabezado: suele ser un punto y coma de más dentro de un campo sin entrecomillar.",
    "fila-duplicada":
        "Eliminar las filas repetidas o documentar por qué el dato aparece más de una vez.",
    "error-encoding":
        "Publicar en UTF-8. Con otra codificación los acentos y las eñes llegan corrompidos.",
    "xls-legado":
        "Exportar en XLSX real: el archivo está declarado como XLSX pero es un Excel 97-2003.",
    "geometria-nula":
        "Revisar las entidades sin geometría: no se pueden situar en un mapa.",
}
DELIVERY_ACTIONS = {
    "descarga":
        "Restablecer el enlace o actualizar la URL de acceso en el catálogo.",
    "error-fuente":
        "Revisar el servicio de origen: rechaza la petición del archivo.",
    "servicio-no-disponible":
        "Revisar el servicio: no responde a las peticiones.",
    "servicio-error":
        "Revisar la configuración del servicio, que rechaza la petición.",
    "no-es-archivo":
        "Apuntar la URL al archivo en sí. Ahora devuelve una página web, así que ningún proceso automático puede consumirlo.",
    "no-es-imagen":
        "Apuntar la URL a la imagen en vez de a una página web.",
    "json-invalido":
        "Corregir el JSON: tal como se publica no se puede interpretar.",
    "xml-no-bien-formado":
        "Corregir el XML: no está bien formado.",
    "xlsx-invalido":
        "Regenerar el XLSX: el archivo publicado no se puede abrir.",
    "zip-invalido":
        "Regenerar el ZIP: no es un archivo comprimido válido.",
    "shp-faltante":
        "Incluir en el ZIP los archivos que acompañan al .shp (.dbf, .shx y .prj).",
    "zip-extraccion":
        "Regenerar el ZIP: no se puede extraer su contenido.",
    "shp-lectura":
        "Revisar el shapefile: no se puede leer.",
    "archivo-vacio":
        "Volver a publicar el archivo: se descarga con 0 bytes.",
    "formato-no-esperado":
        "Hacer coincidir el contenido con el formato declarado, o corregir el formato en el catálogo.",
    "tipo-no-identificado":
        "Revisar el archivo: no se puede identificar su tipo.",
    "geojson-invalido":
        "Corregir el GeoJSON: no cumple la especificación.",
    "ical-invalido":
        "Corregir el iCal: no se puede interpretar.",
    "imagen-corrupta":
        "Volver a publicar la imagen: el archivo está corrupto.",
    "raiz-invalida":
        "Revisar la estructura del documento: la raíz no es la esperada.",
}
DEFAULT_DELIVERY_ACTION = "Revisar el archivo: no se puede descargar o interpretar."

# --- Fixed values: metadata gaps, in report order ---------------------------
# code: (label, field, axis, action)
METADATA_GAPS = {
    "sin-titulo": (
        "Sin título", "dct:title", "completitud",
        "Añadir un título descriptivo.",
    ),
    "sin-descripcion": (
        "Sin descripción", "dct:description", "completitud",
        "Añadir una descripción que diga qué contiene y con qué criterio se recoge.",
    ),
    "sin-licencia-identificada": (
        "Sin licencia identificable", "dct:license", "completitud",
        "Declarar la licencia con un identificador reconocido (CC-BY-4.0 o la licencia IGCYL).",
    ),
    "sin-organismo": (
        "Sin organismo publicador", "dct:publisher", "completitud",
        "Declarar el organismo publicador.",
    ),
    "sin-fecha-publicacion": (
        "Sin fecha de publicación", "dct:issued", "completitud",
        "Añadir la fecha de publicación.",
    ),
    "sin-idioma": (
        "Sin idioma declarado", "dct:language", "completitud",
        "Declarar el idioma del conjunto de datos.",
    ),
    "sin-cobertura": (
        "Sin cobertura territorial", "dct:spatial", "completitud",
        "Declarar el ámbito territorial que cubre el conjunto de datos.",
    ),
    "sin-tematica": (
        "Sin temática", "dcat:theme", "completitud",
        "Asignar al menos una temática de la clasificación sectorial oficial.",
    ),
    "sin-palabras-clave": (
        "Sin palabras clave", "dcat:keyword", "completitud",
        "Añadir palabras clave con los términos que usaría quien busca este dato.",
    ),
    "sin-fecha-actualizacion": (
        "Sin fecha de última actualización", "dct:modified", "actualidad",
        "Publicar la fecha de última actualización y mantenerla al día en cada revisión.",
    ),
    "sin-periodicidad": (
        "Sin periodicidad declarada", "dct:accrualPeriodicity", "actualidad",
        "Declarar cada cuánto se actualiza el conjunto de datos.",
    ),
    "licencia-restrictiva": (
        "Licencia con restricciones de uso", "dct:license", "apertura",
        "Valorar el paso a CC-BY-4.0, que solo exige atribución.",
    ),
    "sin-formato-abierto": (
        "Sin ningún formato abierto", "dcat:distribution", "apertura",
        "Añadir un archivo en CSV, JSON o GeoJSON junto a los existentes.",
    ),
    "sin-identificador": (
        "Sin identificador persistente", "dct:identifier", "recomendacion",
        "Publicar un identificador propio que no cambie con el tiempo.",
    ),
    "sin-punto-contacto": (
        "Sin punto de contacto", "dcat:contactPoint", "recomendacion",
        "Publicar un buzón de contacto atendido.",
    ),
}
GAP_AXIS_ORDER = {"actualidad": 0, "completitud": 1, "apertura": 2, "recomendacion": 3}
COMPLETENESS_GAPS = (
    "sin-titulo", "sin-descripcion", "sin-licencia-identificada",
    "sin-organismo", "sin-fecha-publicacion", "sin-idioma", "sin-cobertura",
    "sin-tematica", "sin-palabras-clave",
)

# --- Fixed values: consequence groups for re-use ----------------------------
# (codes, icon, severity, title)
CONSEQUENCE_GROUPS = (
    (("descarga",), "enlace", "bad", "Un enlace roto es un dato que no existe"),
    (("no-es-archivo", "no-es-imagen"), "no-archivo", "warn", "Un archivo que no es un archivo"),
    (("encabezado-vacio", "encabezado-duplicado"), "encabezado", "warn", "Encabezados vacíos o repetidos"),
    (("error-tipo",), "tipo", "warn", "Tipos mezclados en una misma columna"),
)
FAMILY_PRIORITY = {"entrega": 0, "contenido": 1, "metadatos": 2}
UNCLASSIFIED = "Sin clasificar"
UNKNOWN_CAUSE = "desconocido"

# --- Fixed values: report cuts ----------------------------------------------
TOP_ACTIONS = 12
TOP_CAUSES = 12
MAX_ALERTS = 500
MAX_POSITIONS = 500
PAGE_SIZES = (12, 24, 48)
DEFAULT_PAGE_SIZE = 24
MAX_PAGE_SIZE = 200
SORTS = ("quality-desc", "quality-asc", "title-asc", "date-desc", "date-asc")
DEFAULT_SORT = "date-desc"
ANALYSIS_STATES = ("ok", "parcial", "error", "sin-datos")
MIN_PLAUSIBLE_DATASETS = 500
MIN_RETENTION_RATIO = 0.5
