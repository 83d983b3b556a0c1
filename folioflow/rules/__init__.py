"""folioflow.rules"""
