"""Part of metrelle; see the package README section."""
