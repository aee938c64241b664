"""layerlog.operators"""
