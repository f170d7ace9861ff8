"""Part of gridlark."""
