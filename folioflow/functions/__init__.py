"""folioflow.functions"""
