"""Spelling tables that results depend on."""

# Broken character sequences and their repair, applied in this order.
BROKEN_TEXT = (
    ("Ã©", "é"),
    ("Ã³", "ó"),
    ("Ã¡", "á"),
    ("Ã­", "í"),
    ("Ãº", "ú"),
    ("Ã±", "ñ"),
    ("ÃÂ©", "é"),
    ("ÃÂ³", "ó"),
    ("ÃÂ¡", "á"),
    ("ÃÂ­", "í"),
    ("ÃÂº", "ú"),
    ("ÃÂ", "Á"),
    ("Ã", "Á"),
    ("Â", ""),
)

# Chain spellings (upper case) shown in reports.
CHAINS_IN_REPORTS = {
    "CHEDRAUI": "Chedraui",
    "SORIANA": "Soriana",
    "SAMS CLUB": "Sam's Club",
    "SAMS": "Sam's Club",
    "WALMART": "Walmart",
    "HEB": "HEB",
    "LA COMER": "La Comer",
    "COMERCIAL MEXICANA": "Comercial Mexicana",
    "ALSUPER": "Alsuper",
    "COSTCO": "Costco",
    "CASA LEY": "Casa Ley",
    "CALIMAX": "Calimax",
}

# Chain spellings (upper case) at ingest.
CHAINS_AT_INGEST = {
    "WALMART": "Walmart",
    "SORIANA": "Soriana",
    "CHEDRAUI": "Chedraui",
    "SAMS": "Sam's Club",
    "SAMS CLUB": "Sam's Club",
    "HEB": "HEB",
    "LA COMER": "La Comer",
    "COMERCIAL MEXICANA": "Comercial Mexicana",
    "COSTCO": "Costco",
    "CASA LEY": "Casa Ley",
    "ALSUPER": "Alsuper",
    "CALIMAX": "Calimax",
    "MI TIENDA": "Mi Tienda",
    "OPERADORA MERCO": "Operadora Merco",
    "TIENDA AMIGA": "Tienda Amiga",
    "HOME OFFICE": "Home Office",
    "AGENCIA": "Agencia",
    "ACTIVIDAD": "Actividad",
    "7 ELEVEN": "7-Eleven",
}

# State spellings.
STATES = {
    "DISTRITO FEDERAL": "Ciudad de México",
    "Distrito Federal": "Ciudad de México",
    "CIUDAD DE MEXICO": "Ciudad de México",
    "Ciudad de Mexico": "Ciudad de México",
    "CDMX": "Ciudad de México",
    "cdmx": "Ciudad de México",
    "CMDX": "Ciudad de México",
    "CIDAD DE MEXICO": "Ciudad de México",
    "EDO. DE MEXICO": "Estado de México",
    "ESTADO DE MEXICO": "Estado de México",
    "Estado de Mexico": "Estado de México",
    "MEXICO": "Estado de México",
    "Mexico": "Estado de México",
    "México": "Estado de México",
    "MÉXICO": "Estado de México",
    "San Luis Potosi": "San Luis Potosí",
    "Nuevo Leon": "Nuevo León",
    "JALISCO": "Jalisco",
    "GUANAJUATO": "Guanajuato",
    "PUEBLA": "Puebla",
    "CHIAPAS": "Chiapas",
    "SINALOA": "Sinaloa",
    "NAYARIT": "Nayarit",
    "MORELOS": "Morelos",
    "TABASCO": "Tabasco",
    "SONORA": "Sonora",
    "COLIMA": "Colima",
    "QUINTANA ROO": "Quintana Roo",
    "YUCATAN": "Yucatán",
    "QUERETARO": "Querétaro",
    "CAMPECHE": "Campeche",
    "NUEVOLEON": "Nuevo León",
    "BCS": "Baja California Sur",
}

# Municipality spellings.
MUNICIPALITIES = {
    "TUXTLA GUTIERREZ": "Tuxtla Gutiérrez",
    "Tuxtla Gutierrez": "Tuxtla Gutiérrez",
    "CUAUHTEMOC": "Cuauhtémoc",
    "Cuauhtemoc": "Cuauhtémoc",
    "cuauhtemoc": "Cuauhtémoc",
    "CUAHTEMOC": "Cuauhtémoc",
    "Cuahtemoc": "Cuauhtémoc",
    "BENITO JUAREZ": "Benito Juárez",
    "Benito Juarez": "Benito Juárez",
    "benito juarez": "Benito Juárez",
    "TONALA": "Tonalá",
    "Tonala": "Tonalá",
    "CUAJIMALPA DE MORELOS": "Cuajimalpa de Morelos",
    "CUAJIMALPA": "Cuajimalpa",
    "NEZAHUALCOYOTL": "Nezahualcóyotl",
    "Nezahualcoyotl": "Nezahualcóyotl",
    "SAN CRISTOBAL DE LAS CASAS": "San Cristóbal de las Casas",
    "NAUCALPAN DE JUAREZ": "Naucalpan de Juárez",
    "Naucalpan De Juarez": "Naucalpan de Juárez",
    "GENERAL ESCOBEDO": "General Escobedo",
    "LOS REYES LA PAZ": "Los Reyes La Paz",
    "ATIZAPAN": "Atizapán",
    "Atizapan": "Atizapán",
    "SAN JOSE DEL CABO": "San José del Cabo",
    "San Jose del Cabo": "San José del Cabo",
    "San Jose del cabo": "San José del Cabo",
    "GOMEZ PALACIO": "Gómez Palacio",
    "Gomez Palacio": "Gómez Palacio",
    "SAN ANDRES CHOLULA": "San Andrés Cholula",
    "San Andres Cholula": "San Andrés Cholula",
    "NICOLAS ROMERO": "Nicolás Romero",
    "Nicolas Romero": "Nicolás Romero",
    "NAUCALPAN": "Naucalpan",
    "CUAUTITLAN IZCALLI": "Cuautitlán Izcalli",
    "Cuautitlan Izcalli": "Cuautitlán Izcalli",
    "TECAMAC": "Tecámac",
    "Tecamac": "Tecámac",
    "SAN NICOLAS DE LOS GARZA": "San Nicolás de los Garza",
    "San Nicolas De Los Garza": "San Nicolás de los Garza",
    "SOLEDAD DE GRACIANO SANCHEZ": "Soledad de Graciano Sánchez",
    "Soledad de Graciano Sanchez": "Soledad de Graciano Sánchez",
    "CIUDAD DE MEXICO": "Ciudad de México",
    "Ciudad De Mexico": "Ciudad de México",
    "AZCAPOTZALCO": "Azcapotzalco",
    "QUERETARO": "Querétaro",
    "CANCUN": "Cancún",
    "Cancun": "Cancún",
    "IXTAPALUCA": "Ixtapaluca",
    "ixtapaluca": "Ixtapaluca",
    "LOS CABOS": "Los Cabos",
    "Los cabos": "Los Cabos",
    "LEON": "León",
    "MERIDA": "Mérida",
}
